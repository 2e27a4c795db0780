"""Schemas and vocabularies of the knowledge graph (fixed values of the data model)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S = T.StringType()
TRIPLES = T.StructType(
    [T.StructField(n, _S) for n in ("triple_id", "subject", "predicate", "object", "source_kind", "target_kind", "evidence")]
    + [T.StructField("confidence", T.DoubleType())]
    + [T.StructField(n, _S) for n in ("source_doc", "extraction_method", "timestamp", "adapter", "layer", "source")]
    + [T.StructField("lineage", T.ArrayType(_S)), T.StructField("valid_from", _S), T.StructField("valid_to", _S), T.StructField("schema_version", _S), T.StructField("object_is_literal", T.BooleanType()), T.StructField("object_datatype", _S)]
)
#: What a column holds where an older table lacks it.
DEFAULTS = {"layer": "source_facts", "source": "", "schema_version": "1", "object_is_literal": False}

# Layers, predicates and thresholds of the data model.
LAYERS = ["source_facts", "normalised_triples", "inferred_relations", "llm_hypotheses"]
TRUSTED = ["source_facts", "normalised_triples", "inferred_relations"]
EXTRACTED_PREDICATES = ["PROPOSED_BY", "TYPE_OF", "IMPROVES_ON", "EXTENDS", "EVALUATES_ON", "ACHIEVES", "SCALES_TO", "USED_IN", "AUTHORED_BY", "PUBLISHED_IN", "RELATED_TO", "DEFINED_AS", "PART_OF", "REQUIRES", "OUTPERFORMS", "IMPLEMENTED_IN", "SIMILAR_TO"]
EXTRACTED_KINDS = ["Algorithm", "Concept", "Paper", "Person", "Dataset", "Organization", "Metric", "System", "Value"]
SEMANTIC_PREDICATES = [*EXTRACTED_PREDICATES, "SAME_AS", "LINKS_TO"]
STRONG_PREDICATES = ["SIMILAR_TO", "SAME_AS", "RELATED_TO"]
NOISE_PREDICATES = ["HAS_FILE_TYPE", "CONTAINS_KEY", "HAS_TAG"]
UNSERIALISED = ["CONTAINS_KEY", "HAS_FILE_TYPE"]
AUTO_MERGE, FLAG_FLOOR, SEMANTIC_FLOOR, STRING_WEIGHT = 0.85, 0.70, 0.90, 0.6
ANCHOR_FLOOR, HYPOTHESIS_BELOW = 0.3, 0.75


@dataclass(frozen=True)
class Shape:
    """Constraint on the triples of one predicate."""

    predicate: str
    allowed_target_kinds: tuple[str, ...] = ()
    min_count: int = 0
    max_count: int | None = None
    datatype: str | None = None
    severity: str = "Violation"


@dataclass(frozen=True)
class Vocabulary:
    """What an adapter may produce; an empty list allows anything."""

    name: str
    predicates: tuple[str, ...] = ()
    source_kinds: tuple[str, ...] = ()
    target_kinds: tuple[str, ...] = ()
    shapes: tuple[Shape, ...] = field(default_factory=tuple)


HEADINGS = tuple(f"heading:h{i}" for i in range(1, 7))
UNIVERSAL = Vocabulary(
    "universal", ("HAS_FILE_TYPE", "CONTAINS_HEADING", "LINKS_TO", "REFERENCES_URL", "HAS_TAG", "CONTAINS_KEY", "HAS_COLUMN"), ("document",),
    ("file_type", "heading", *HEADINGS, "vault_link", "url_host", "tag", "key", "column"),
)
VAULT = Vocabulary(
    "vault", ("HAS_FILE_TYPE", "CONTAINS_HEADING", "LINKS_TO", "REFERENCES_URL_HOST", "HAS_TAG"), ("document",),
    ("file_type", *HEADINGS, "vault_link", "local_link", "url_host", "tag"),
)
EXTRACTOR = Vocabulary("llm", tuple(EXTRACTED_PREDICATES), tuple(EXTRACTED_KINDS), tuple(EXTRACTED_KINDS))


def triple_id() -> Column:
    """24 hex digits over subject, predicate, object, source_doc and layer; nulls count as ''."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("subject", "predicate", "object", "source_doc", "layer")]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24)


def conform(df: DataFrame, *more: str) -> DataFrame:
    """``df`` with exactly the columns of TRIPLES and ``more``: missing ones get defaults, others are dropped, ids are computed where absent."""
    out = df
    for f in TRIPLES.fields:
        if f.name not in out.columns and f.name != "triple_id":
            out = out.withColumn(f.name, F.array().cast(f.dataType) if f.name == "lineage" else F.lit(DEFAULTS.get(f.name)).cast(f.dataType))
    if "triple_id" not in out.columns:
        out = out.withColumn("triple_id", triple_id())
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TRIPLES.fields], *more)
