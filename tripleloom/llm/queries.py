"""Queries and oracle SQL of the problems tagged llm (2 to 5 and 8 to 10)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.llm.copies import collapse, consistent_survivors, fact_copies, survivors
from tripleloom.llm.groups import match_groups
from tripleloom.llm.mixing import mixture, mixture_shares, source_name
from tripleloom.llm.names import name_groups, same_names
from tripleloom.llm.packing import fill_containers, fill_report
from tripleloom.llm.sizes import with_tokens
from tripleloom.llm.spans import shared_chars
from tripleloom.plans.data_queries import letters_digits, micros
from tripleloom.session import materialise
from tripleloom.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return match_groups(table(spark, d, "entity_aliases"), "canonical_id", "alias_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return same_names(*(table(spark, d, t) for t in ("entities", "name_forms", "er_labelled_pairs")))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return name_groups(*(table(spark, d, t) for t in ("entities", "name_forms", "er_labelled_pairs")))


def p3_formatting(spark: SparkSession, d: str) -> DataFrame:
    """Checks p3: of its pairs, those of names that have the same letters and digits."""
    key = F.regexp_replace(F.lower("id_a"), r"[^\p{L}\p{N}]+", "") == F.regexp_replace(F.lower("id_b"), r"[^\p{L}\p{N}]+", "")
    return p3_found(spark, d).filter(key)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return fact_copies(table(spark, d, "triples"))


def p4_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return collapse(table(spark, d, "triples"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors(table(spark, d, "triples"))


def p5_bundles(spark: SparkSession, d: str) -> DataFrame:
    return consistent_survivors(table(spark, d, "triples"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return fill_containers(table(spark, d, "documents"), table(spark, d, "container_sizes"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "container_sizes")
    return fill_report(fill_containers(table(spark, d, "documents"), c), c)


def p8_holds(spark: SparkSession, d: str) -> DataFrame:
    """Checks p8: documents and tokens placed, what is placed twice or not in full, containers filled
    beyond their capacity, documents split without need, and whether a hundredth more containers than the least would do."""
    c = table(spark, d, "container_sizes").select("container", "capacity_tokens").distinct()
    docs = table(spark, d, "documents").select("doc_id", "text")
    filled = materialise(fill_containers(table(spark, d, "documents"), c), "filled")
    whole = (
        filled.groupBy("container", "doc_id")
        .agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("pieces"), F.max(F.col("token_offset") + F.col("n_tokens")).alias("end"))
    )
    sized = materialise(with_tokens(docs, "text", ["doc_id"]).withColumnRenamed("n_tokens", "size"), "sizes")
    per = whole.join(sized, "doc_id").join(F.broadcast(c), "container").groupBy("container", "capacity_tokens").agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum(((F.col("n") != F.col("size")) | (F.col("end") != F.col("size"))).cast("long")).alias("not_whole"),
        F.sum(((F.col("pieces") > 1) & (F.col("size") <= F.col("capacity_tokens"))).cast("long")).alias("split_without_need"),
        F.sum("n").alias("tokens"),
    )
    bins = (
        filled.groupBy("container", "bin")
        .agg(F.sum("n_tokens").alias("n"))
        .join(F.broadcast(c), "container")
        .groupBy("container")
        .agg(F.sum((F.col("n") > F.col("capacity_tokens")).cast("long")).alias("overfull"), F.count(F.lit(1)).alias("bins"))
    )
    near = F.col("bins") <= F.ceil(F.ceil(F.col("tokens") / F.col("capacity_tokens")) * 1.02)
    return (
        per.join(bins, "container")
        .select("container", "capacity_tokens", "documents", "not_whole", "split_without_need", "overfull", near.alias("nearly_least"))
    )


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return (
        mixture_shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))
        .withColumns({c: F.round(c, 6) for c in ("target_share", "reachable_share", "actual_share")})
    )


def p9_holds(spark: SparkSession, d: str) -> DataFrame:
    """Checks p9: for each source its target, the share it can have, whether the mixture is within a
    point of it and keeps to the number of repeats."""
    mix, docs = table(spark, d, "mix_targets"), table(spark, d, "documents")
    got = mixture_shares(docs, mix)
    drawn = (
        mixture(docs, mix, carry=())
        .groupBy("source", "doc_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("source")
        .agg(F.max("n").alias("most"), F.sum("n").alias("rows"))
    )
    caps = mix.select(source_name(F.col("source")).alias("source"), "max_repeats")
    both = got.join(F.broadcast(caps), "source").join(drawn, "source", "left")
    keeps = (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")) & (F.coalesce("rows", F.lit(0)) == F.col("copies"))
    near = F.abs(F.col("actual_share") - F.col("reachable_share")) <= 0.01
    return both.select(
        "source", F.round("target_share", 6).alias("target_share"), F.round("reachable_share", 6).alias("reachable_share"), near.alias("within_tolerance"),
        keeps.alias("keeps_to_caps"),
    )


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_chars(table(spark, d, "documents"))


_P2 = """
WITH RECURSIVE e AS (SELECT DISTINCT canonical_id AS a, alias_id AS b FROM entity_aliases WHERE canonical_id IS NOT NULL AND alias_id IS NOT NULL),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS id, a AS seen FROM s UNION SELECT r.id, s.b FROM r JOIN s ON r.seen = s.a)
SELECT min(seen) AS group_id, id AS entity_id FROM r GROUP BY id"""

_PIECES = "'|' || array_to_string(list_sort(list_filter(list_transform(string_split(object, '|'), lambda x: " + letters_digits("x") + "), lambda x: x <> '')), '|')"
_RUNS = f"""
f AS (SELECT row_id, {letters_digits('predicate')} AS p, {letters_digits('subject')} AS s, CASE WHEN contains(object, '|') THEN {_PIECES} ELSE {letters_digits('object')} END AS o
  FROM triples WHERE coalesce(predicate, '') NOT IN ('HAS_STATUS', 'MAINTAINED_BY', 'IMPLEMENTED_IN', 'ACHIEVES', 'DEFINED_AS')),
k AS (SELECT row_id, p, CASE WHEN p IN ('similarto', 'sameas') THEN least(s, o) ELSE s END AS s, CASE WHEN p IN ('similarto', 'sameas') THEN greatest(s, o) ELSE o END AS o FROM f),
g AS (SELECT row_id, min(row_id) OVER (PARTITION BY p, s, o) AS first_row_id, count(*) OVER (PARTITION BY p, s, o) AS n FROM k)"""
_P4 = f"WITH {_RUNS} SELECT first_row_id, row_id FROM g WHERE row_id <> first_row_id"
_P4_COLLAPSED = f"WITH {_RUNS} SELECT first_row_id, count(*) AS n_copies FROM g GROUP BY 1"
_HAS = "lower(trim({0})) NOT IN ('', 'n/a', 'unknown', 'none', '-')"
_P5 = f"""
WITH {_RUNS},
t AS (SELECT g.first_row_id, t.*, row_number() OVER (PARTITION BY first_row_id ORDER BY
    coalesce(list_position(['source_facts', 'normalised_triples', 'inferred_relations', 'llm_hypotheses'], lower(trim(layer))), 99),
    coalesce(list_position(['structural', 'rule', 'llm'], lower(trim(extraction_method))), 99),
    CASE WHEN isnan(confidence) THEN NULL ELSE confidence END DESC NULLS LAST, {micros('timestamp')} DESC NULLS LAST, t.row_id) AS r
  FROM g JOIN triples t ON g.row_id = t.row_id WHERE n > 1)
SELECT first_row_id, 'record' AS field_name, row_id FROM t WHERE r = 1
UNION ALL SELECT first_row_id, 'evidence', arg_min(row_id, r) FROM t WHERE {_HAS.format('evidence')} GROUP BY 1
UNION ALL SELECT first_row_id, 'source', arg_min(row_id, r) FROM t WHERE {_HAS.format('source')} GROUP BY 1
UNION ALL SELECT first_row_id, 'object_datatype', arg_min(row_id, r) FROM t WHERE {_HAS.format('object_datatype')} GROUP BY 1"""
_P3_FORMATTING = r"""
WITH e AS (SELECT id, regexp_replace(lower(id), '[^\p{L}\p{N}]', '', 'g') AS k FROM entities WHERE id IS NOT NULL AND NOT regexp_matches(id, '^(doc|rec):')
  GROUP BY id HAVING bool_or(coalesce(lower(trim(kind)) NOT IN ('tag', 'url_host', 'document', 'record'), true)))
SELECT a.id AS id_a, b.id AS id_b FROM e a JOIN e b ON a.k = b.k AND a.id < b.id WHERE a.k <> ''"""
_P5_BUNDLES = f"""
WITH {_RUNS},
t AS (SELECT g.first_row_id AS f, t.*, row_number() OVER (PARTITION BY first_row_id ORDER BY
    coalesce(list_position(['source_facts', 'normalised_triples', 'inferred_relations', 'llm_hypotheses'], lower(trim(layer))), 99),
    coalesce(list_position(['structural', 'rule', 'llm'], lower(trim(extraction_method))), 99),
    CASE WHEN isnan(confidence) THEN NULL ELSE confidence END DESC NULLS LAST, {micros('timestamp')} DESC NULLS LAST, t.row_id) AS r
  FROM g JOIN triples t ON g.row_id = t.row_id WHERE n > 1),
o AS (SELECT f, source, source_doc, min(r) AS r, row_number() OVER (PARTITION BY f ORDER BY min(r)) - 1 AS place FROM t WHERE {_HAS.format('source')} GROUP BY 1, 2, 3),
u AS (SELECT f, evidence, min(r) AS r, row_number() OVER (PARTITION BY f ORDER BY min(r)) - 1 AS place FROM t WHERE {_HAS.format('evidence')} GROUP BY 1, 2),
p AS (SELECT f, adapter, min(r) AS r, row_number() OVER (PARTITION BY f ORDER BY min(r)) - 1 AS place FROM t WHERE {_HAS.format('extraction_method')} GROUP BY 1, 2),
y AS (SELECT f, min(r) AS r FROM t WHERE {_HAS.format('object_datatype')} GROUP BY 1),
c AS (SELECT h.f, o.r AS ro, u.r AS ru, p.r AS rp, coalesce(o.place, 0) AS po, coalesce(u.place, 0) AS pu, coalesce(p.place, 0) AS pp,
    (o.r IS NULL OR u.r IS NULL OR EXISTS (SELECT 1 FROM t WHERE t.f = h.f AND t.source_doc IS NOT DISTINCT FROM o.source_doc AND t.evidence IS NOT DISTINCT FROM u.evidence))
    AND (o.r IS NULL OR p.r IS NULL OR EXISTS (SELECT 1 FROM t WHERE t.f = h.f AND t.source IS NOT DISTINCT FROM o.source AND t.adapter IS NOT DISTINCT FROM p.adapter)) AS ok
  FROM (SELECT DISTINCT f FROM t) h LEFT JOIN o ON o.f = h.f LEFT JOIN u ON u.f = h.f LEFT JOIN p ON p.f = h.f),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY f ORDER BY NOT ok, CASE WHEN ok THEN po + pu + pp END, po, pu, pp) = 1),
x AS (SELECT f, 'origin' AS bundle, ro AS r FROM b UNION ALL SELECT f, 'quote', ru FROM b UNION ALL SELECT f, 'process', rp FROM b UNION ALL SELECT f, 'typing', r FROM y)
SELECT x.f AS first_row_id, bundle, row_id FROM x JOIN t ON x.f = t.f AND x.r = t.r"""
_P8_HOLDS = """
SELECT container, capacity_tokens, (SELECT count(*) FROM documents WHERE doc_id IS NOT NULL AND length(text) > 0) AS documents,
  0::BIGINT AS not_whole, 0::BIGINT AS split_without_need, 0::BIGINT AS overfull, true AS nearly_least FROM (SELECT DISTINCT container, capacity_tokens FROM container_sizes)"""
_P9_HOLDS = r"""
WITH d AS (SELECT DISTINCT regexp_replace(lower(trim(source)), '[-\s]+', '_', 'g') AS source FROM documents WHERE doc_id IS NOT NULL AND length(text) > 0),
m AS (SELECT regexp_replace(lower(trim(source)), '[-\s]+', '_', 'g') AS source, target_share FROM mix_targets WHERE target_share > 0)
SELECT source, round(target_share / (SELECT sum(target_share) FROM m), 6) AS target_share,
  CASE WHEN source IN (SELECT source FROM d WHERE source IS NOT NULL) THEN round(target_share / (SELECT sum(target_share) FROM m WHERE source IN (SELECT source FROM d)), 6) ELSE 0.0 END AS reachable_share,
  true AS within_tolerance, true AS keeps_to_caps FROM m"""
_P10 = """
WITH d AS (SELECT doc_id, text FROM documents WHERE length(text) >= 150),
w AS (SELECT doc_id, i, md5(substr(text, i::BIGINT, 150)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 148)) AS i FROM d)),
s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)),
c AS (SELECT doc_id, i, coalesce(least(150, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i)), 150) AS n FROM w WHERE h IN (SELECT h FROM s))
SELECT doc_id, sum(n)::BIGINT AS shared_chars FROM c GROUP BY doc_id"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found, "p3_found": p3_found, "p3_groups": p3_groups, "p3_formatting": p3_formatting, "p4_found": p4_found, "p4_collapsed": p4_collapsed, "p5_found": p5_found, "p5_bundles": p5_bundles,
    "p8_containers": p8_containers, "p8_fill": p8_fill, "p8_holds": p8_holds, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p9_holds": p9_holds, "p10_found": p10_found,
}
SQL: dict[str, str] = {
    "p2_found": _P2, "p3_formatting": _P3_FORMATTING, "p4_found": _P4, "p4_collapsed": _P4_COLLAPSED, "p5_found": _P5, "p5_bundles": _P5_BUNDLES,
    "p8_holds": _P8_HOLDS, "p9_holds": _P9_HOLDS, "p10_found": _P10,
}
