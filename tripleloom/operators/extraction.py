"""Model-based extraction: sections of a text, a pluggable client, replies parsed into triples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripleloom.operators.rules import strip
from tripleloom.schema import EXTRACTED_KINDS, EXTRACTED_PREDICATES, HYPOTHESIS_BELOW, triple_id

MIN_SECTION = 60
#: Characters of a section that one call gets, as the model's context allows.
CALL_CHARS = 4000
SYSTEM = "Extract triples that the text states, as JSON {\"triples\": [{subject, subject_type, predicate, object, object_type, evidence, confidence}]}. Predicates: " + ", ".join(EXTRACTED_PREDICATES) + ". Types: " + ", ".join(EXTRACTED_KINDS) + "."
_REPLY = "struct<triples:array<struct<subject:string,subject_type:string,predicate:string,object:string,object_type:string,evidence:string,confidence:string>>>"


def sections(texts: DataFrame, doc: str = "doc_id", text: str = "text", max_sections: int | None = None) -> DataFrame:
    """(doc_id, section_no, section): texts cut before headings of level 1 to 3, without front matter
    and code fences; pieces of less than 60 characters are left out. A section longer than a call holds is
    several, each with a number of its own; ``max_sections`` counts it once."""
    body = F.regexp_replace(F.regexp_replace(F.col(text), r"(?s)^---\n.*?\n---\n", ""), r"(?m)^```[^\n]*\n?", "")
    parts = F.split(body, r"(?m)(?=^#{1,3}\s+.+$)")
    cut = (
        texts.filter(F.col(text).isNotNull())
        .select(F.col(doc).alias("doc_id"), F.posexplode(parts).alias("n", "section"))
        .withColumn("section", strip(F.col("section")))
        .filter(F.length("section") >= MIN_SECTION)
    )
    if max_sections is not None:
        cut = cut.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("n"))).filter(F.col("k") <= max_sections)
    starts = F.sequence(F.lit(1), F.length("section"), F.lit(CALL_CHARS))
    cut = cut.select("doc_id", "n", F.posexplode(F.transform(starts, lambda i: F.substring(F.col("section"), i, F.lit(CALL_CHARS)))).alias("part", "section"))
    return cut.withColumn("section_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("n", "part")) - 1).select("doc_id", "section_no", "section")


def call(parts: DataFrame, client: Callable[[str, str], str]) -> DataFrame:
    """``parts`` with ``reply``: one call a section on the executors; a failing call gives null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            replies = []
            for s in f["section"]:
                try:
                    replies.append(client(s, SYSTEM))
                except Exception:  # noqa: BLE001
                    replies.append(None)
            yield f.assign(reply=replies)

    return parts.mapInPandas(
        run, parts.select("doc_id", "section_no", "section").schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", reply string",
    )


def parse_replies(replies: DataFrame, reply: str = "reply", doc: str = "doc_id") -> DataFrame:
    """Triples of JSON replies, code fences stripped. Replies that are no such JSON give none; items
    without subject, predicate or object, or with a confidence that is no number, are left out; a
    missing confidence is 0.8, one outside 0..1 is clamped; under 0.75 the layer is llm_hypotheses.
    """
    bare = F.regexp_replace(F.regexp_replace(F.col(reply), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    items = (
        replies.select(F.col(doc).cast("string").alias("source_doc"), F.explode(F.from_json(bare, _REPLY)["triples"]).alias("t"))
        .select("source_doc", "t.*")
    )
    conf = F.when(F.col("confidence").isNull(), F.lit(0.8)).otherwise(F.col("confidence").try_cast("double"))
    ok = items.withColumn("c", conf).filter("subject is not null and predicate is not null and object is not null and c is not null")
    entity = F.lit("Entity")
    out = ok.select(
        F.substring("subject", 1, 240).alias("subject"), F.substring("predicate", 1, 80).alias("predicate"), F.substring("object", 1, 240).alias("object"),
        F.coalesce("subject_type", entity).alias("source_kind"), F.coalesce("object_type", entity).alias("target_kind"), F.substring(F.coalesce("evidence", F.lit("")), 1, 700).alias("evidence"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("c"))).alias("confidence"), "source_doc", F.lit("llm").alias("extraction_method"), F.lit("llm").alias("adapter"),
        F.when(F.col("c") < HYPOTHESIS_BELOW, F.lit("llm_hypotheses")).otherwise(F.lit("source_facts")).alias("layer"),
    )
    return out.withColumn("triple_id", triple_id())
