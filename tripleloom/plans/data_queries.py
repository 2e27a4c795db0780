"""Queries and oracle SQL of the general data problems (1, 6, 7)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tripleloom.operators.hierarchy import descendants, hierarchy, hierarchy_found
from tripleloom.operators.history import history_found
from tripleloom.operators.orphans import orphan_report
from tripleloom.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return history_found(table(spark, d, "triples"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(*(table(spark, d, t) for t in ("triples", "entities", "entity_aliases", "community_members", "communities")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy_found(table(spark, d, "communities"))


def p7_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(hierarchy(table(spark, d, "communities"), "community_id", "parent_community_id", "created_at"))


# Times: a blank stands for T, text without zone is UTC, a date is its midnight.
_MICROS = """epoch_us(try_cast(CASE WHEN regexp_matches(trim({0}), '^\\d{{4}}-\\d\\d-\\d\\d$') THEN trim({0}) || 'T00:00:00+00:00'
  WHEN regexp_matches(trim({0}), '(Z|[+-]\\d\\d:?\\d\\d)$') THEN trim({0}) ELSE trim({0}) || '+00:00' END AS TIMESTAMPTZ))"""
_LD = r"regexp_replace(lower(nfc_normalize({0})), '[^\p{{L}}\p{{N}}]', '', 'g')"


def micros(c: str) -> str:
    return _MICROS.format(c)


def letters_digits(c: str) -> str:
    return _LD.format(c)


_P1 = f"""
WITH r AS (SELECT subject, predicate, {micros('timestamp')} AS seen, row_id, coalesce({micros('valid_from')}, {micros('timestamp')}) AS s, {micros('valid_to')} AS e,
    trim(regexp_replace(lower(object), '\\s+', ' ', 'g')) AS v FROM triples
  WHERE predicate IN ('HAS_STATUS', 'MAINTAINED_BY', 'IMPLEMENTED_IN', 'ACHIEVES', 'DEFINED_AS')),
h AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY subject, predicate, s ORDER BY seen DESC NULLS LAST, row_id DESC) = 1),
k AS (SELECT subject, predicate, s, v, CASE WHEN e > s THEN e END AS e FROM h WHERE s IS NOT NULL),
n AS (SELECT *, lead(s) OVER w AS nx, CASE WHEN lag(s) OVER w IS NULL OR lag(v) OVER w IS DISTINCT FROM v OR lag(e) OVER w <= s THEN 1 ELSE 0 END AS o
  FROM k WINDOW w AS (PARTITION BY subject, predicate ORDER BY s)),
g AS (SELECT *, sum(o) OVER (PARTITION BY subject, predicate ORDER BY s) AS g FROM n),
f AS (SELECT subject, predicate, g, min(s) AS a, arg_max(least(coalesce(e, 253402214400000000), coalesce(nx, 253402214400000000)), s) AS z FROM g GROUP BY ALL)
SELECT subject, predicate, strftime(make_timestamp(a), '%Y-%m-%dT%H:%M:%SZ') AS version_from,
  CASE WHEN z = 253402214400000000 THEN '9999-12-31T00:00:00Z' ELSE strftime(make_timestamp(z), '%Y-%m-%dT%H:%M:%SZ') END AS version_to FROM f"""

_P6 = f"""
WITH p AS (SELECT {letters_digits('id')} AS k, strftime(min(created_at), '%Y-%m') AS b, strftime(max(deleted_at), '%Y-%m') AS g FROM entities WHERE id IS NOT NULL GROUP BY 1),
c AS (SELECT community_id, min(created_at) AS t FROM communities GROUP BY 1),
r AS (SELECT 'triples' AS table_name, 'subject' AS column_name, strftime(make_timestamp({micros('timestamp')}), '%Y-%m') AS period, subject AS id FROM triples
  UNION SELECT 'triples', 'object', strftime(make_timestamp({micros('timestamp')}), '%Y-%m'), object FROM triples WHERE NOT coalesce(object_is_literal, false)
  UNION SELECT 'entity_aliases', 'alias_id', strftime(resolved_at, '%Y-%m'), alias_id FROM entity_aliases
  UNION SELECT 'community_members', 'entity_id', strftime(c.t, '%Y-%m'), m.entity_id FROM community_members m LEFT JOIN c ON m.community_id = c.community_id),
x AS (SELECT DISTINCT table_name, column_name, period, {letters_digits('id')} AS ref_key FROM r WHERE id IS NOT NULL)
SELECT table_name, column_name, period, ref_key, CASE WHEN p.k IS NULL THEN 'missing' WHEN b > period THEN 'late' ELSE 'deleted' END AS state
FROM x LEFT JOIN p ON p.k = x.ref_key WHERE p.k IS NULL OR b > period OR g < period"""

_P7_BASE = r"""
WITH RECURSIVE h AS (SELECT community_id AS id, trim(parent_community_id, E' \t\n\r\f\v') AS p FROM communities WHERE community_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY community_id ORDER BY created_at DESC NULLS LAST, trim(parent_community_id, E' \t\n\r\f\v') DESC NULLS LAST) = 1),
n AS (SELECT a.id, b.id AS p FROM h a LEFT JOIN h b ON a.p = b.id),
t AS (SELECT id, id AS root, 0 AS depth, id AS path FROM n WHERE p IS NULL UNION ALL SELECT n.id, t.root, t.depth + 1, t.path || '/' || n.id FROM n JOIN t ON n.p = t.id)"""
_P7 = _P7_BASE + """,
u AS (SELECT id AS id, p AS spot FROM n WHERE id NOT IN (SELECT id FROM t) UNION SELECT u.id, n.p FROM u JOIN n ON u.spot = n.id),
l AS (SELECT DISTINCT spot FROM u WHERE id = spot),
m AS (SELECT id, min(spot) AS root FROM u WHERE spot IN (SELECT spot FROM l) GROUP BY id)
SELECT id AS community_id, root AS root_id, depth::INT AS depth, path FROM t UNION ALL SELECT id, root, -1, '' FROM m"""
_P7_DESC = _P7_BASE + """,
e AS (SELECT id, p AS anc, 1 AS distance FROM n WHERE p IS NOT NULL AND id IN (SELECT id FROM t) UNION ALL SELECT e.id, n.p, e.distance + 1 FROM e JOIN n ON e.anc = n.id WHERE n.p IS NOT NULL)
SELECT anc AS ancestor, id AS descendant, distance::INT AS distance FROM e"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p6_found": p6_found, "p7_found": p7_found, "p7_descendants": p7_descendants}
SQL: dict[str, str] = {"p1_found": _P1, "p6_found": _P6, "p7_found": _P7, "p7_descendants": _P7_DESC}
