"""Shape validation of triples: vocabulary, target classes, datatypes, cardinality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.schema import Vocabulary


def _finding(when: Column, severity: str, detail: Column) -> Column:
    return F.when(when, F.struct(F.lit(severity).alias("severity"), detail.alias("detail")))


def findings(triples: DataFrame, vocabulary: Vocabulary, doc: str = "source_doc") -> DataFrame:
    """``triples`` with ``findings``: array of (severity, detail), in the order of the rules.

    Cardinality counts (subject, predicate) within one document. It is a map-side aggregation that is
    joined back, so a subject with a third of all rows is no single task.
    """
    p, sk, tk = F.col("predicate"), F.col("source_kind"), F.col("target_kind")
    got: list[Column] = []
    for allowed, c, what in ((vocabulary.predicates, p, "predicate"), (vocabulary.source_kinds, sk, "source_kind"), (vocabulary.target_kinds, tk, "target_kind")):
        if allowed:
            got.append(_finding(~F.coalesce(c.isin(list(allowed)), F.lit(False)), "Violation", F.concat(F.lit(f"unknown {what} "), F.coalesce(c, F.lit("null")))))
    counted = triples.groupBy(doc, "subject", "predicate").agg(F.count(F.lit(1)).alias("_n"))
    keys = [doc, "subject", "predicate"]
    shaped = sorted({s.predicate for s in vocabulary.shapes if s.min_count or s.max_count is not None})
    if shaped:
        small = counted.filter(F.col("predicate").isin(shaped)).select(*[F.col(k).alias(f"_{k}") for k in keys], "_n")
        on = [triples[k].eqNullSafe(small[f"_{k}"]) for k in keys]
        t = triples.join(small, on, "left").drop(*[f"_{k}" for k in keys])
    else:
        t = triples.withColumn("_n", F.lit(0).cast("long"))
    for s in vocabulary.shapes:
        mine = p == s.predicate
        if s.allowed_target_kinds:
            got.append(_finding(mine & ~F.coalesce(tk.isin(list(s.allowed_target_kinds)), F.lit(False)), "Violation", F.concat(F.lit("target kind "), F.coalesce(tk, F.lit("null")), F.lit(" is not allowed"))))
        if s.datatype:
            got.append(_finding(mine & F.coalesce("object_is_literal", F.lit(False)) & ~F.col("object_datatype").eqNullSafe(F.lit(s.datatype)), s.severity, F.concat(F.lit("datatype "), F.coalesce("object_datatype", F.lit("null")), F.lit(f" is not {s.datatype}"))))
        if s.min_count:
            got.append(_finding(mine & (F.col("_n") < s.min_count), s.severity, F.concat(F.col("_n").cast("string"), F.lit(f" is fewer than {s.min_count}"))))
        if s.max_count is not None:
            got.append(_finding(mine & (F.col("_n") > s.max_count), s.severity, F.concat(F.col("_n").cast("string"), F.lit(f" is more than {s.max_count}"))))
    empty = F.array().cast("array<struct<severity:string,detail:string>>")
    return t.withColumn("findings", F.array_compact(F.array(*got)) if got else empty).drop("_n")


def message() -> Column:
    """One text a triple: its shape of kinds and every finding; null if there is none."""
    severities = F.transform("findings", lambda f: f["severity"])
    worst = F.when(F.array_contains(severities, "Violation"), "VIOLATION").when(F.array_contains(severities, "Warning"), "WARNING").otherwise("INFO")
    details = F.array_join(F.transform("findings", lambda f: F.concat(F.lit("["), f["severity"], F.lit("] "), f["detail"])), "; ")
    return F.when(
        F.size("findings") > 0,
        F.concat(F.lit("SCHEMA "), worst, F.lit(" ("), F.coalesce("subject", F.lit("")), F.lit(" -"), F.coalesce("predicate", F.lit("")), F.lit("-> "), F.coalesce("object", F.lit("")), F.lit("): "), details),
    )


def validate(triples: DataFrame, vocabulary: Vocabulary, strict: bool = False, doc: str = "source_doc") -> DataFrame:
    """``triples`` with findings, message and ``accepted``: strict refuses rows with a Violation, else all pass."""
    f = findings(triples, vocabulary, doc).withColumn("message", message())
    refused = F.exists("findings", lambda x: x["severity"] == "Violation") if strict else F.lit(False)
    return f.withColumn("accepted", ~refused)


