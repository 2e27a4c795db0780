"""Queries and oracle SQL of the knowledge-graph operators, over whole tables."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripleloom.engine import Engine
from tripleloom.functions import naming
from tripleloom.functions.naming import initials, normalise
from tripleloom.operators import communities as com
from tripleloom.operators import extraction, graph, index, resolve, retrieval, rules, store, validate, vectors
from tripleloom.schema import NOISE_PREDICATES, SEMANTIC_PREDICATES, STRONG_PREDICATES, TRUSTED, UNSERIALISED, Shape, Vocabulary
from tripleloom.session import materialise, scratch_folder
from tripleloom.sources.files import flatten_json_column
from tripleloom.sources.tables import table
from tripleloom.streaming.ingest import rate_window

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
QUESTION = "Which relation index supersedes the alignment ontology of the matcher?"


def q(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def triples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "triples")


def focus(spark: SparkSession, d: str) -> str:
    """The subject with most triples: one row."""
    r = triples(spark, d).filter("subject is not null").groupBy("subject").count().orderBy(F.desc("count"), "subject").first()
    return r["subject"] if r else ""


_FOCUS = "f AS (SELECT subject AS s FROM triples WHERE subject IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


def one(spark: SparkSession, value: str) -> DataFrame:
    return spark.createDataFrame([(value,)], "id string")


# --- store -------------------------------------------------------------------------------------


@q(
    "SELECT row_id, substr(sha256(coalesce(subject, '') || '|' || coalesce(predicate, '') || '|' || coalesce(object, '') || '|' || coalesce(source_doc, "
    "'') || '|' || coalesce(layer, '')), 1, 24) AS computed_id FROM triples"
)
def triple_ids(s, d):
    return store.with_triple_ids(triples(s, d)).select("row_id", "computed_id")


@q("SELECT 'entities' AS what, count(DISTINCT id) AS n FROM entities UNION ALL SELECT 'triples', count(*) FROM triples")
def stats_totals(s, d):
    return (
        table(s, d, "entities")
        .agg(F.countDistinct("id").alias("n"))
        .select(F.lit("entities").alias("what"), "n")
        .union(triples(s, d).agg(F.count(F.lit(1)).alias("n")).select(F.lit("triples").alias("what"), "n"))
    )


@q("SELECT layer, count(*) AS n FROM triples GROUP BY 1")
def stats_layer(s, d):
    return triples(s, d).groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


@q("SELECT predicate, count(*) AS n FROM triples GROUP BY 1 ORDER BY n DESC, predicate LIMIT 20")
def stats_predicate_top20(s, d):
    return triples(s, d).groupBy("predicate").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "predicate").limit(20)


@q("SELECT row_id, triple_id, subject, object FROM triples WHERE predicate = 'LINKS_TO' AND layer = 'source_facts' ORDER BY triple_id, row_id LIMIT 100")
def store_query_filter(s, d):
    return store.query(triples(s, d), predicate="LINKS_TO", layer="source_facts").select("row_id", "triple_id", "subject", "object")


@q(
    f"WITH {_FOCUS}, k AS (SELECT id, min(kind) AS subject_kind FROM entities GROUP BY 1) SELECT row_id, triple_id, subject, predicate, object, timestamp, "
    f"subject_kind FROM triples JOIN k ON subject = id WHERE subject = (SELECT s FROM f) OR object = (SELECT s FROM f)"
)
def provenance_lookup(s, d):
    return (
        store.provenance(triples(s, d), table(s, d, "entities"), focus(s, d))
        .select("row_id", "triple_id", "subject", "predicate", "object", "timestamp", "subject_kind")
    )


@q(
    f"WITH {_FOCUS} (SELECT row_id, triple_id, 'out' AS direction FROM triples WHERE subject = (SELECT s FROM f) ORDER BY triple_id, row_id LIMIT 25) "
    f"UNION ALL (SELECT row_id, triple_id, 'in' FROM triples WHERE object = (SELECT s FROM f) ORDER BY triple_id, row_id LIMIT 25)"
)
def node_view(s, d):
    return store.node_view(triples(s, d), focus(s, d), 25).select("row_id", "triple_id", "direction")


_ENDS = (
    "e AS (SELECT subject AS id, source_kind AS kind, row_id * 2 AS seq FROM triples UNION ALL SELECT object, target_kind, row_id * 2 + 1 FROM triples), "
    "k AS (SELECT id, kind FROM e QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1)"
)


@q(f"WITH {_ENDS} SELECT id, kind FROM k")
def entity_first_kind(s, d):
    return store.first_kinds(triples(s, d), "row_id")


@q(f"WITH {_ENDS} SELECT DISTINCT e.id, k.kind, e.kind AS other FROM e JOIN k ON e.id = k.id WHERE e.kind IS DISTINCT FROM k.kind")
def kind_conflicts(s, d):
    return store.kind_conflicts(triples(s, d), "row_id")


@q(
    "WITH i AS (SELECT triple_id, count(*) AS n FROM triples GROUP BY 1), o AS (SELECT DISTINCT triple_id FROM triples WHERE layer = 'source_facts') "
    "SELECT sum(CASE WHEN o.triple_id IS NULL THEN 1 ELSE 0 END)::BIGINT AS added, sum(CASE WHEN o.triple_id IS NULL THEN n - 1 ELSE n END)::BIGINT AS "
    "skipped FROM i LEFT JOIN o ON i.triple_id = o.triple_id"
)
def upsert_counts(s, d):
    t = triples(s, d)
    return store.insert_counts(t.filter("layer = 'source_facts'"), t)


@q(
    "SELECT min(row_id) AS row_id, triple_id FROM triples WHERE triple_id NOT IN (SELECT triple_id FROM triples WHERE layer = 'source_facts') GROUP BY "
    "triple_id"
)
def upsert_new_rows(s, d):
    t = triples(s, d)
    return store.new_triples(t.filter("layer = 'source_facts'"), t, "row_id").select("row_id", "triple_id")


@q(
    "WITH a AS (SELECT subject AS id FROM triples UNION SELECT object FROM triples), k AS (SELECT subject AS id FROM triples WHERE layer IS DISTINCT FROM "
    "'source_facts' UNION SELECT object FROM triples WHERE layer IS DISTINCT FROM 'source_facts') SELECT id FROM a EXCEPT SELECT id FROM k"
)
def purge_layer_orphans(s, d):
    t = triples(s, d)
    ents = store.first_kinds(t, "row_id")
    _, kept = store.purge_layer(t, ents, "source_facts")
    return ents.join(kept.select("id"), "id", "left_anti").select("id")


@q(
    "SELECT row_id, 'confidence' AS reason FROM triples WHERE NOT coalesce(confidence BETWEEN 0 AND 1, false) UNION ALL SELECT row_id, 'layer' FROM "
    "triples WHERE coalesce(layer, '') NOT IN ('source_facts', 'normalised_triples', 'inferred_relations', 'llm_hypotheses')"
)
def row_checks(s, d):
    return store.row_checks(triples(s, d))


# --- graph -------------------------------------------------------------------------------------


def _reach(where: str, depth: int) -> str:
    return f"""e AS (SELECT subject AS a, object AS b FROM triples WHERE {where} UNION SELECT object, subject FROM triples WHERE {where}),
r AS (SELECT s AS n, 0 AS d FROM f UNION SELECT b, d + 1 FROM r JOIN e ON n = a WHERE d < {depth} AND a <> b)"""


@q(f"WITH RECURSIVE {_FOCUS}, {_reach('true', 4)} SELECT n AS node, min(d)::INT AS depth FROM r GROUP BY 1")
def hop_distances(s, d):
    return graph.hop_distances(triples(s, d), one(s, focus(s, d)), 4)


@q(f"WITH RECURSIVE {_FOCUS}, {_reach('true', 2)} SELECT row_id FROM triples WHERE subject IN (SELECT n FROM r) OR object IN (SELECT n FROM r)")
def neighbourhood_2hop(s, d):
    return graph.neighbourhood(triples(s, d), one(s, focus(s, d)), 2).select("row_id")


_L = "layer = 'inferred_relations'"


@q(f"WITH RECURSIVE {_FOCUS}, {_reach(_L, 2)} SELECT row_id FROM triples WHERE {_L} AND (subject IN (SELECT n FROM r) OR object IN (SELECT n FROM r))")
def neighbourhood_layer(s, d):
    return graph.neighbourhood(triples(s, d), one(s, focus(s, d)), 2, "inferred_relations").select("row_id")


_T = f"layer IN {_in(TRUSTED)}"


@q(f"WITH RECURSIVE {_FOCUS}, {_reach(_T, 2)} SELECT row_id FROM triples WHERE {_T} AND (subject IN (SELECT n FROM r) OR object IN (SELECT n FROM r))")
def expand_trusted_2hop(s, d):
    return graph.expand(triples(s, d), one(s, focus(s, d)), 2).select("row_id")


@q(f"WITH {_FOCUS} SELECT DISTINCT triple_id FROM triples WHERE {_T} AND (subject = (SELECT s FROM f) OR object = (SELECT s FROM f)) ORDER BY 1 LIMIT 50")
def expand_capped_first(s, d):
    """The first node's triples come first, fifty by triple_id."""
    rows = graph.expand_capped(triples(s, d), [focus(s, d)], 2)
    return s.createDataFrame([(r["triple_id"],) for r in rows[:50]], "triple_id string")


@q(f"WITH RECURSIVE {_FOCUS}, {_reach(_T, 2)} SELECT true AS within_caps, true AS once, true AS within_reach")
def expand_capped_holds(s, d):
    rows = graph.expand_capped(triples(s, d), [focus(s, d)], 2)
    ids = [r["triple_id"] for r in rows]
    near = {r["node"] for r in graph.hop_distances(triples(s, d).filter(F.col("layer").isin(TRUSTED)), one(s, focus(s, d)), 2).collect()} if len(rows) <= 550 else set()
    return s.createDataFrame(
        [(len(ids) <= 550, len(ids) == len(set(ids)), all(r["subject"] in near or r["object"] in near for r in rows))],
        "within_caps boolean, once boolean, within_reach boolean",
    )


@q(
    f"WITH RECURSIVE {_FOCUS}, {_reach('true', 3)}, n AS (SELECT n, min(d) AS d FROM r GROUP BY 1) SELECT max(d)::INT AS steps, true AS joined, true AS "
    f"known FROM n"
)
def path_holds(s, d):
    """A shortest path to one of the farthest nodes: as many edges as hops, each meets the next, all are triples."""
    t, a = triples(s, d), focus(s, d)
    far = graph.hop_distances(t, one(s, a), 3).orderBy(F.desc("depth"), "node").first()
    p = graph.shortest_path(t, a, far["node"], 4) or []
    at, joined = a, True
    for e in p:
        joined = joined and at in (e["subject"], e["object"])
        at = e["object"] if e["subject"] == at else e["subject"]
    edges = s.createDataFrame([(e["subject"], e["predicate"], e["object"]) for e in p], "subject string, predicate string, object string").distinct()
    known = edges.join(t.select("subject", "predicate", "object").distinct(), ["subject", "predicate", "object"], "left_anti").count() == 0
    return s.createDataFrame([(len(p), joined and at == far["node"], known)], "steps int, joined boolean, known boolean")


_NOISE = (
    f"SELECT DISTINCT least(subject, object) AS a, greatest(subject, object) AS b FROM triples WHERE predicate NOT IN {_in(NOISE_PREDICATES)} AND subject "
    f"<> object AND subject IN (SELECT id FROM entities) AND object IN (SELECT id FROM entities)"
)


@q(f"WITH e AS ({_NOISE}), s AS (SELECT a AS id FROM e UNION ALL SELECT b FROM e) SELECT id, count(*) AS degree FROM s GROUP BY 1")
def adjacency_degree(s, d):
    return vectors.adjacency(triples(s, d), table(s, d, "entities")).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


_COMPONENTS = (
    "WITH RECURSIVE e AS (SELECT subject AS a, object AS b FROM triples WHERE predicate IN ('SIMILAR_TO', 'SAME_AS')), s AS (SELECT a, b FROM e UNION "
    "SELECT b, a FROM e), r AS (SELECT a AS id, a AS seen FROM s UNION SELECT r.id, s.b FROM r JOIN s ON r.seen = s.a)"
)


@q(f"{_COMPONENTS} SELECT id, arg_min(seen, (length(seen), seen)) AS root FROM r GROUP BY 1")
def similar_components(s, d):
    return graph.components(triples(s, d).filter("predicate in ('SIMILAR_TO', 'SAME_AS')"), "subject", "object", graph.shortest_first)


# --- rules over texts --------------------------------------------------------------------------

_W = r"[\s\p{Z}\x{85}\x1c-\x1f]"
_LINES = rf"""l AS (SELECT doc_id, unnest(x) AS raw, generate_subscripts(x, 1) - 1 AS line_no FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS x FROM documents WHERE text IS NOT NULL)),
n AS (SELECT doc_id, line_no, regexp_replace(raw, '^{_W}+|{_W}+$', '', 'g') AS line FROM l), t AS (SELECT * FROM n WHERE line <> '')"""


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_W}+|{_W}+$', '', 'g')"



_NOTES = """documents AS (SELECT p_partkey AS doc_id, '# ' || p_name || chr(10) || upper(p_name) || chr(10) || 'See [[' || p_type || '#top|it]] and [' || p_name || '](HTTPS://Host' || p_size || '.Example.org/a?b=' || p_partkey || ') #' || replace(p_brand, '#', '-') || ', or http://www' || p_size || '.example.com/x' || chr(13) || chr(10) || '  ## ' || p_brand || '  ' AS text FROM part)"""


def notes(s, d) -> DataFrame:
    """Texts rendered from parts, so that every rule has input."""
    text = (
        "concat('# ', p_name, '\\n', upper(p_name), '\\n', 'See [[', p_type, '#top|it]] and [', p_name, '](HTTPS://Host', p_size, '.Example.org/a?b=', "
        "p_partkey, ') #', replace(p_brand, '#', '-'), ', or http://www', p_size, '.example.com/x', '\\r\\n', '  ## ', p_brand, '  ')"
    )
    return table(s, d, "part").select(F.col("p_partkey").alias("doc_id"), F.expr(text).alias("text"))


def _rule(s, d, no: int, adapter: str = "universal", rendered: bool = False) -> DataFrame:
    return (
        rules.candidates(notes(s, d) if rendered else table(s, d, "documents"), "doc_id", "text", rules._rules(adapter))
        .filter(F.col("rule") == no)
        .select("doc_id", "line_no", "match", "object")
    )


_HEAD = rf"^(#{{1,6}}){_W}+(.+?){_W}*$"


@q(
    f"WITH {_LINES} SELECT doc_id, line_no, {_strip(f'''regexp_extract(line, '{_HEAD}', 2)''')} AS object, 'heading:h' || length(regexp_extract(line, "
    f"'{_HEAD}', 1)) AS kind FROM t WHERE regexp_matches(line, '{_HEAD}')"
)
def rule_heading(s, d):
    return (
        rules.candidates(table(s, d, "documents"), "doc_id", "text", rules._rules("universal"))
        .filter("rule = 0")
        .select("doc_id", "line_no", "object", "kind")
    )


@q(
    rf"WITH {_NOTES}, {_LINES} SELECT doc_id, line_no, array_to_string(list_transform(regexp_extract_all(line, '\p{{L}}+|\P{{L}}+'), lambda p: upper(p[1]) "
    rf"|| lower(p[2:])), '') AS object FROM t WHERE length(line) < 80 AND upper(line) = line AND lower(line) <> line AND len(regexp_split_to_array(line, "
    rf"'{_W}+')) <= 8 AND NOT regexp_matches(line, '{_HEAD}')"
)
def notes_caps_heading(s, d):
    return _rule(s, d, 1, rendered=True).drop("match")


def _matches(pattern: str, group: int = 1, strip: bool = False) -> str:
    v = f"regexp_extract_all(line, '{pattern}', {group})"
    o = _strip("object") if strip else "object"
    return f"SELECT doc_id, line_no, match::INT AS match, {o} AS object FROM (SELECT doc_id, line_no, unnest({v}) AS object, generate_subscripts({v}, 1) - 1 AS match FROM t)"


_WIKI = r"\[\[([^\]|#]+)(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]"


@q(f"WITH {_LINES} SELECT * FROM ({_matches(_WIKI, 1, True)}) WHERE object <> ''")
def rule_wiki_link(s, d):
    return _rule(s, d, 2)


_MD = r"\[([^\]]{1,160})\]\(([^)]+)\)"


@q(
    rf"WITH {_NOTES}, {_LINES} SELECT doc_id, line_no, lower(regexp_extract(object, '(?i)^https?://(?:[^/?#]*@)?([^/?#:@]+)', 1)) AS object FROM "
    rf"({_matches(_MD, 2, True)}) WHERE regexp_matches(object, '(?i)^https?://(?:[^/?#]*@)?([^/?#:@]+)')"
)
def notes_markdown_link(s, d):
    return _rule(s, d, 3, rendered=True).drop("match")


@q(f"WITH {_NOTES}, {_LINES} {_matches(rules.URL.replace('(?U)', '').replace(chr(39), chr(39) * 2))}")
def notes_url_host(s, d):
    return _rule(s, d, 4, rendered=True)


@q(
    rf"WITH {_NOTES}, {_LINES} SELECT * FROM ({_matches(r'(?:^|[^\p{L}\p{N}\p{M}_/])#([A-Za-z][A-Za-z0-9_-]{1,60})' + chr(92) + 'b')}) WHERE (doc_id, "
    rf"line_no) NOT IN (SELECT doc_id, line_no FROM t WHERE line LIKE '#%')"
)
def notes_hashtag(s, d):
    return _rule(s, d, 5, rendered=True)


@q(
    rf"WITH {_LINES}, k AS (SELECT doc_id, line_no, ltrim({_strip('''substr(line, 1, instr(line, ': ') - 1)''')}, '.') AS k, {_strip('''substr(line, instr(line, ': ') + 2)''')} "
    rf"AS v FROM t WHERE contains(line, ': ') AND NOT starts_with(line, '-') AND NOT starts_with(line, 'Columns:')) SELECT doc_id, line_no, k || '=' || v "
    rf"AS object FROM k WHERE k <> '' AND v <> '' AND length(v) < 200"
)
def rule_key_value(s, d):
    return rules.candidates(table(s, d, "documents"), "doc_id", "text", rules._structured_rules()).filter("rule = 1").select("doc_id", "line_no", "object")


@q(
    rf"WITH {_LINES}, c AS ({_matches(_WIKI, 1, True)}), x AS (SELECT *, row_number() OVER (PARTITION BY doc_id, object[:240] ORDER BY line_no, match) AS a "
    rf"FROM c WHERE object <> ''), y AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, match) AS place FROM x WHERE a = 1) SELECT "
    rf"doc_id, object, place FROM y WHERE place <= 40"
)
def first_facts_links(s, d):
    found = rules.candidates(table(s, d, "documents"), "doc_id", "text", [rules._rules("universal")[2]])
    return rules.first_facts(found, 40).select("doc_id", "object", F.col("place").cast("long").alias("place"))


def _notes(s, d) -> DataFrame:
    return table(s, d, "documents").withColumn("relative_path", F.concat(F.lit("notes/"), F.col("doc_id").cast("string"), F.lit(".md")))


def _cand(no: int, predicate: str, obj: str, kind: str, evidence: str, confidence: float, source: str) -> str:
    return f"SELECT doc_id, line_no, {no} AS rule, match, {predicate} AS predicate, {obj} AS object, {kind} AS kind, {evidence} AS evidence, {confidence} AS confidence FROM ({source})"


def _found(pattern: str, groups: dict[str, int], where: str = "true") -> str:
    lists = ", ".join(f"unnest(regexp_extract_all(line, '{pattern}', {g})) AS {n}" for n, g in groups.items())
    first = next(iter(groups.values()))
    return f"SELECT doc_id, line_no, line, {lists}, generate_subscripts(regexp_extract_all(line, '{pattern}', {first}), 1) - 1 AS match FROM t WHERE {where}"


_URLS, _WEBRE = rules.URL.replace("(?U)", "").replace("'", "''"), "(?i)^https?://(?:[^/?#]*@)?([^/?#:@]+)"
_TITLE = r"array_to_string(list_transform(regexp_extract_all(line, '\p{L}+|\P{L}+'), lambda p: upper(p[1]) || lower(p[2:])), '')"
_TAGRE = r"(?:^|[^\p{L}\p{N}\p{M}_/])#([A-Za-z][A-Za-z0-9_-]{1,60})" + chr(92) + "b"
_LINKED = f"SELECT doc_id, line_no, {_strip('label')} AS label, {_strip('url')} AS url, match FROM ({_found(_MD, {'label': 1, 'url': 2})})"
_HEADS = f"SELECT doc_id, line_no, line, 0 AS match, length(regexp_extract(line, '{_HEAD}', 1)) AS n, {_strip(f"""regexp_extract(line, '{_HEAD}', 2)""")} AS v FROM t WHERE regexp_matches(line, '{_HEAD}')"
_CAPS = (
    rf"SELECT doc_id, line_no, line, 0 AS match FROM t WHERE length(line) < 80 AND upper(line) = line AND lower(line) <> line AND "
    rf"len(regexp_split_to_array(line, '{_W}+')) <= 8 AND NOT regexp_matches(line, '{_HEAD}')"
)
_UNIVERSAL = [
    _cand(0, "'CONTAINS_HEADING'", "v", "'heading:h' || n", "'H' || n || ': ' || v", 0.90, _HEADS),
    _cand(1, "'CONTAINS_HEADING'", _TITLE, "'heading'", "line", 0.70, _CAPS),
    _cand(2, "'LINKS_TO'", _strip("v"), "'vault_link'", "line", 0.86, _found(_WIKI, {"v": 1})),
    _cand(3, "'REFERENCES_URL'", f"lower(regexp_extract(url, '{_WEBRE}', 1))", "'url_host'", "'Link: ' || label", 0.82, f"SELECT * FROM ({_LINKED}) WHERE regexp_matches(url, '{_WEBRE}')"),
    _cand(4, "'REFERENCES_URL'", "v", "'url_host'", "line", 0.75, _found(_URLS, {"v": 1})),
    _cand(5, "'HAS_TAG'", "v", "'tag'", "line", 0.82, _found(_TAGRE, {"v": 1}, "NOT starts_with(line, '#')")),
]
_VAULT = [
    _UNIVERSAL[0],
    _UNIVERSAL[2].replace("2 AS rule", "1 AS rule", 1),
    _cand(2, f"CASE WHEN regexp_matches(url, '{_WEBRE}') THEN 'REFERENCES_URL_HOST' ELSE 'LINKS_TO' END", f"CASE WHEN regexp_matches(url, '{_WEBRE}') THEN lower(regexp_extract(url, '{_WEBRE}', 1)) WHEN label <> '' THEN label ELSE url END", f"CASE WHEN regexp_matches(url, '{_WEBRE}') THEN 'url_host' ELSE 'local_link' END", "'Link: ' || label", 0.80, f"SELECT * FROM ({_LINKED}) WHERE regexp_matches(url, '{_WEBRE}') OR (url <> '' AND NOT regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:'))").replace("0.8 AS confidence", f"CASE WHEN regexp_matches(url, '{_WEBRE}') THEN 0.82 ELSE 0.80 END AS confidence"),
    _UNIVERSAL[5].replace("5 AS rule", "3 AS rule", 1),
]


def _extract_sql(rules_: list[str], cap: int, key: str, with_: str = "") -> str:
    return f"""WITH {with_}{_LINES}, c AS ({' UNION ALL '.join(rules_)}), x AS (SELECT * FROM c WHERE {_strip('object')} <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, predicate, {key} ORDER BY line_no, rule, match) = 1),
y AS (SELECT *, 1 + row_number() OVER (PARTITION BY doc_id ORDER BY line_no, rule, match) AS place FROM x QUALIFY place <= {cap})
SELECT doc_id::VARCHAR AS subject, predicate, substr(object, 1, 240) AS object, kind AS target_kind, substr(evidence, 1, 700) AS evidence, confidence::DOUBLE AS confidence, place::INT AS place FROM y
UNION ALL SELECT doc_id::VARCHAR, 'HAS_FILE_TYPE', 'md', 'file_type', 'File: notes/' || doc_id || '.md', 0.95, 1 FROM documents WHERE {_strip('text')} <> ''"""


_EXTRACTED = ["subject", "predicate", "object", "target_kind", "evidence", "confidence", "place"]


def _path(df: DataFrame) -> DataFrame:
    return df.withColumn("relative_path", F.concat(F.lit("notes/"), F.col("doc_id").cast("string"), F.lit(".md")))


@q(_extract_sql(_UNIVERSAL, rules.FACTS["universal"], "object[:240]"))
def extract_universal(s, d):
    return rules.extract(_notes(s, d), "universal", max_facts=rules.FACTS["universal"]).select(*_EXTRACTED)


@q(_extract_sql(_VAULT, rules.FACTS["vault"], "object"))
def extract_vault(s, d):
    return rules.extract(_notes(s, d), "vault", max_facts=rules.FACTS["vault"]).select(*_EXTRACTED)


@q(_extract_sql(_UNIVERSAL, 1_000_000, "object[:240]", _NOTES + ", "))
def extract_rendered_universal(s, d):
    """Texts in which every rule has input; without a cap."""
    return rules.extract(_path(notes(s, d)), "universal").select(*_EXTRACTED)


@q(_extract_sql(_VAULT, 1_000_000, "object", _NOTES + ", "))
def extract_rendered_vault(s, d):
    return rules.extract(_path(notes(s, d)), "vault").select(*_EXTRACTED)


_SECTIONS = rf"""b AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(?s)^---\n.*?\n---\n', ''), '(?m)^```[^\n]*\n?', '', 'g') AS body FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, string_split(regexp_replace(body, '(?m)^(#{{1,3}}\s+.+)$', chr(1) || '\1', 'g'), chr(1)) AS x FROM b), u AS (SELECT doc_id, unnest(x) AS raw, generate_subscripts(x, 1) AS n FROM p),
v AS (SELECT doc_id, n, {_strip('raw')} AS section FROM u), w AS (SELECT doc_id, n, section, unnest(range(1, length(section) + 1, {extraction.CALL_CHARS})) AS spot FROM v WHERE length(section) >= {extraction.MIN_SECTION}),
s AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n, spot) - 1 AS section_no, substr(section, spot, {extraction.CALL_CHARS}) AS section FROM w)"""


@q(f"WITH {_SECTIONS} SELECT doc_id, section_no::INT AS section_no, section FROM s")
def section_split(s, d):
    return extraction.sections(table(s, d, "documents"))


def _measure(text: str, system: str) -> str:
    """A client that states how long the section is, unsure where it is long; it fails on one kind of section."""
    if text.startswith("## "):
        raise RuntimeError("no answer")
    return json.dumps({"triples": [{"subject": text[:20], "subject_type": "Concept", "predicate": "DEFINED_AS", "object": str(len(text)), "object_type": "Value", "confidence": 0.6 if len(text) > 500 else 0.9}]})


@q(
    f"WITH {_SECTIONS} SELECT doc_id::VARCHAR AS source_doc, substr(section, 1, 20) AS subject, length(section)::VARCHAR AS object, CASE WHEN "
    f"length(section) > 500 THEN 'llm_hypotheses' ELSE 'source_facts' END AS layer, CASE WHEN length(section) > 500 THEN 0.6 ELSE 0.9 END::DOUBLE AS "
    f"confidence FROM s WHERE NOT starts_with(section, '## ')"
)
def llm_extraction(s, d):
    """Sections of all documents through a client and the reader of its replies; failed calls give nothing."""
    replies = extraction.call(extraction.sections(table(s, d, "documents")), _measure)
    return extraction.parse_replies(replies).select("source_doc", "subject", "object", "layer", "confidence")


@q("SELECT event_id, unnest(json_keys(props)) AS path, json_extract_string(props, '$.' || unnest(json_keys(props))) AS value FROM events")
def json_flatten(s, d):
    return flatten_json_column(table(s, d, "events"), "event_id", "props")


@q(
    "SELECT subject, predicate, object, CASE WHEN coalesce(confidence, 0.8) < 0.75 THEN 'llm_hypotheses' ELSE 'source_facts' END AS layer, "
    "coalesce(confidence, 0.8) AS confidence FROM (SELECT substr(subject, 1, 240) AS subject, substr(predicate, 1, 80) AS predicate, substr(object, 1, "
    "240) AS object, CASE WHEN confidence IS NOT NULL THEN least(1.0, greatest(0.0, confidence)) END AS confidence FROM triples WHERE subject IS NOT NULL "
    "AND predicate IS NOT NULL AND object IS NOT NULL)"
)
def llm_reply_parse(s, d):
    item = F.struct(
        "subject", F.col("source_kind").alias("subject_type"), "predicate", "object", F.col("target_kind").alias("object_type"), "evidence", "confidence",
    )
    replies = (
        triples(s, d)
        .select(F.col("source_doc").alias("doc_id"), F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array(item).alias("triples"))), F.lit("\n```")).alias("reply"))
    )
    return extraction.parse_replies(replies).select("subject", "predicate", "object", "layer", "confidence")


# --- validation --------------------------------------------------------------------------------

VOCABULARY = Vocabulary(
    "checked",
    tuple(sorted({*SEMANTIC_PREDICATES, *NOISE_PREDICATES, "CONTAINS_HEADING", "REFERENCES_URL", "HAS_COLUMN"})),
    ("concept", "document", "record"),
    (),
    (
        Shape("PART_OF", ("concept",)),
        Shape("HAS_FILE_TYPE", max_count=1, severity="Warning"),
        Shape("CONTAINS_HEADING", min_count=2, severity="Info"),
        Shape("CONTAINS_KEY", datatype="xsd:string", severity="Warning"),
    ),
)
_COUNTS = "c AS (SELECT source_doc, subject, predicate, count(*) AS n FROM triples GROUP BY ALL)"
_ON = "t.source_doc IS NOT DISTINCT FROM c.source_doc AND t.subject IS NOT DISTINCT FROM c.subject AND t.predicate = c.predicate"
_SHACL = f"""WITH {_COUNTS}, x AS (SELECT row_id, 'Violation' AS severity, 'unknown predicate ' || coalesce(predicate, 'null') AS detail FROM triples WHERE coalesce(predicate, '') NOT IN {_in(VOCABULARY.predicates)}
UNION ALL SELECT row_id, 'Violation', 'unknown source_kind ' || coalesce(source_kind, 'null') FROM triples WHERE coalesce(source_kind, '') NOT IN ('concept', 'document', 'record')
UNION ALL SELECT row_id, 'Violation', 'target kind ' || coalesce(target_kind, 'null') || ' is not allowed' FROM triples WHERE predicate = 'PART_OF' AND coalesce(target_kind, '') <> 'concept'
UNION ALL SELECT row_id, 'Warning', n || ' is more than 1' FROM triples t JOIN c ON {_ON} WHERE t.predicate = 'HAS_FILE_TYPE' AND n > 1
UNION ALL SELECT row_id, 'Info', n || ' is fewer than 2' FROM triples t JOIN c ON {_ON} WHERE t.predicate = 'CONTAINS_HEADING' AND n < 2
UNION ALL SELECT row_id, 'Warning', 'datatype ' || coalesce(object_datatype, 'null') || ' is not xsd:string' FROM triples WHERE predicate = 'CONTAINS_KEY' AND object_is_literal AND object_datatype IS DISTINCT FROM 'xsd:string')"""


@q(f"{_SHACL} SELECT * FROM x")
def shacl_findings(s, d):
    return validate.findings(triples(s, d), VOCABULARY).select("row_id", F.explode("findings").alias("f")).select("row_id", "f.severity", "f.detail")


@q(f"{_SHACL} SELECT row_id, row_id NOT IN (SELECT row_id FROM x WHERE severity = 'Violation') AS accepted FROM triples")
def shacl_strict(s, d):
    return validate.validate(triples(s, d), VOCABULARY, strict=True).select("row_id", "accepted")


_RANKED = _SHACL.replace("SELECT row_id, 'Violation' AS severity", "SELECT 1 AS no, row_id, 'Violation' AS severity", 1)
for _no in range(2, 7):
    _RANKED = _RANKED.replace("UNION ALL SELECT row_id", f"UNION ALL SELECT {_no}, row_id", 1)


@q(f"""{_RANKED}, m AS (SELECT row_id, CASE WHEN bool_or(severity = 'Violation') THEN 'VIOLATION' WHEN bool_or(severity = 'Warning') THEN 'WARNING' ELSE 'INFO' END AS worst, string_agg('[' || severity || '] ' || detail, '; ' ORDER BY no) AS details FROM x GROUP BY 1)
SELECT row_id, 'SCHEMA ' || worst || ' (' || coalesce(subject, '') || ' -' || coalesce(predicate, '') || '-> ' || coalesce(object, '') || '): ' || details AS message FROM m JOIN triples USING (row_id)""")
def shacl_messages(s, d):
    return validate.validate(triples(s, d), VOCABULARY).filter("message is not null").select("row_id", "message")


# --- resolution --------------------------------------------------------------------------------


def names(s, d) -> DataFrame:
    """All entities, opaque ids too, as the engine resolves them."""
    return table(s, d, "entities")


_NORM = "regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g')"
_NAMES = "e AS (SELECT id, kind FROM entities WHERE id IS NOT NULL)"
_CLASSES = f"{_NAMES}, c AS (SELECT kind, {_NORM.format('id')} AS norm, min(id) AS id FROM e GROUP BY 1, 2 HAVING {_NORM.format('min(id)')} <> '')"
_INITIALS = (
    "CASE WHEN len(list_filter(regexp_split_to_array({0}, '[^A-Za-z0-9]+'), lambda w: w <> '')) >= 2 THEN "
    "lower(array_to_string(list_transform(list_filter(regexp_split_to_array({0}, '[^A-Za-z0-9]+'), lambda w: w <> ''), lambda w: w[1]), '')) END"
)
_PAIRS = (
    f"{_CLASSES}, z AS (SELECT kind, count(*) AS m FROM c GROUP BY 1), b AS (SELECT c.*, CASE WHEN m <= 256 THEN '*' ELSE 'p:' || norm[:2] END AS block "
    f"FROM c JOIN z ON c.kind IS NOT DISTINCT FROM z.kind), p AS (SELECT x.kind, x.id AS a, y.id AS b, x.norm AS na, y.norm AS nb FROM b x JOIN b y ON "
    f"x.kind IS NOT DISTINCT FROM y.kind AND x.block = y.block AND x.id < y.id)"
)
_SHORT = f"(coalesce(na = {_INITIALS.format('b')}, false) OR coalesce(nb = {_INITIALS.format('a')}, false))"
_SCORED = (
    f"{_PAIRS}, j AS (SELECT *, {_SHORT} AS short, jaro_winkler_similarity(na, nb) AS jw FROM p), m AS (SELECT kind, a, b, CASE WHEN short THEN 0.97 ELSE "
    f"jw END AS score, CASE WHEN short THEN 'initialism' ELSE 'jaro_winkler' END AS method, CASE WHEN short OR jw >= 0.85 THEN 'auto' WHEN jw >= 0.70 THEN "
    f"'flagged' ELSE 'none' END AS band FROM j)"
)


@q(
    f"WITH {_NAMES}, n AS (SELECT DISTINCT kind, {_NORM.format('id')} AS norm, id FROM e), g AS (SELECT kind, norm, min(id) AS canonical FROM n WHERE norm "
    f"<> '' GROUP BY 1, 2 HAVING count(*) > 1) SELECT g.kind, g.norm, g.canonical, n.id FROM g JOIN n ON g.kind = n.kind AND g.norm = n.norm"
)
def er_exact_groups(s, d):
    return resolve.exact_groups(names(s, d))


@q(
    f"WITH {_NAMES}, i AS (SELECT DISTINCT id FROM e) SELECT DISTINCT x.id AS short_id, y.id AS long_id FROM i x JOIN i y ON {_NORM.format('x.id')} = "
    f"{_INITIALS.format('y.id')} WHERE {_NORM.format('x.id')} <> ''"
)
def er_initialisms(s, d):
    n = names(s, d).select("id").distinct()
    a = n.select(F.col("id").alias("short_id"), normalise(F.col("id")).alias("k")).filter("k <> ''")
    b = n.select(F.col("id").alias("long_id"), initials(F.col("id")).alias("k"))
    return a.join(b, "k").select("short_id", "long_id")


@q(f"WITH {_PAIRS} SELECT kind, a, b FROM p")
def er_blocked_candidates(s, d):
    return resolve.candidate_pairs(resolve.blocks(resolve.classes(names(s, d)))).select("kind", "a", "b")


@q(f"WITH {_SCORED} SELECT kind, a, b, round(score, 6) AS score, method, band FROM m WHERE band <> 'none'")
def er_scored_pairs(s, d):
    return resolve.matches(names(s, d)).select("kind", "a", "b", F.round("score", 6).alias("score"), "method", "band")


_CANON = f"""WITH RECURSIVE {_SCORED}, x AS (SELECT kind, {_NORM.format('id')} AS norm, id FROM e), k AS (SELECT a, b FROM m WHERE band = 'auto' UNION SELECT x.id, c.id FROM x JOIN c ON x.kind = c.kind AND x.norm = c.norm WHERE x.id <> c.id
  UNION SELECT subject, object FROM triples WHERE predicate = 'SIMILAR_TO' AND subject <> object), y AS (SELECT a, b FROM k UNION SELECT b, a FROM k), r AS (SELECT a AS id, a AS seen FROM y UNION SELECT r.id, y.b FROM r JOIN y ON r.seen = y.a), g AS (SELECT id, arg_min(seen, (length(seen), seen)) AS canonical FROM r GROUP BY 1)"""


@q(f"{_CANON} SELECT id, canonical FROM g")
def er_canonical(s, d):
    return resolve.resolve(names(s, d), triples(s, d))["canonical"]


@q(f"""{_CANON}, w AS (SELECT same, coalesce(ga.canonical, id_a) = coalesce(gb.canonical, id_b) AS said FROM er_labelled_pairs LEFT JOIN g ga ON ga.id = id_a LEFT JOIN g gb ON gb.id = id_b WHERE same IS NOT NULL AND id_a IS NOT NULL AND id_b IS NOT NULL),
v AS (SELECT count(*) FILTER (same AND said) AS tp, count(*) FILTER (NOT same AND said) AS fp, count(*) FILTER (same AND NOT said) AS fn FROM w)
SELECT tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM v""")
def er_f1(s, d):
    return resolve.pair_quality(table(s, d, "er_labelled_pairs"), resolve.resolve(names(s, d), triples(s, d))["canonical"])


@q(f"""{_CANON}, o AS (SELECT x.kind, x.norm, min(x.id) AS canonical FROM x WHERE norm <> '' GROUP BY 1, 2),
h AS (SELECT o.canonical AS a, x.id AS b, 1 AS phase, 1.0 AS score, 'exact_normalised' AS method FROM o JOIN x ON o.kind = x.kind AND o.norm = x.norm WHERE x.id <> o.canonical
  UNION ALL SELECT a, b, 2, score, method FROM m WHERE band = 'auto' UNION ALL SELECT subject, object, 3, 0.80, 'structural_wcc' FROM triples WHERE predicate = 'SIMILAR_TO' AND subject <> object),
n AS (SELECT id, min((phase, -score, method)) AS e FROM (SELECT a AS id, phase, score, method FROM h UNION ALL SELECT b, phase, score, method FROM h) GROUP BY 1)
SELECT canonical AS canonical_id, g.id AS alias_id, round(-e[2], 6)::DOUBLE AS confidence, e[1]::INT AS phase, e[3] AS method FROM g JOIN n ON g.id = n.id WHERE canonical <> g.id""")
def er_resolve_aliases(s, d):
    return resolve.resolve(names(s, d), triples(s, d))["aliases"].withColumn("confidence", F.round("confidence", 6))


@q(
    "SELECT DISTINCT id, round(jaro_winkler_similarity(regexp_replace(lower(id), '[^a-z0-9]+', '', 'g'), 'graphindex'), 6) AS similarity FROM entities "
    "WHERE id IS NOT NULL"
)
def sql_functions(s, d):
    """The registered functions in SQL text."""
    naming.register(s)
    table(s, d, "entities").createOrReplaceTempView("_entities")
    return s.sql("SELECT DISTINCT id, round(jaro_winkler(regexp_replace(lower(id), '[^a-z0-9]+', ''), 'graphindex'), 6) AS similarity FROM _entities WHERE id IS NOT NULL AND metaphone(id) IS NOT NULL")


@q(
    "SELECT DISTINCT alias_id FROM entity_aliases WHERE alias_id IS NOT NULL AND canonical_id = (SELECT canonical_id FROM entity_aliases WHERE "
    "canonical_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
)
def aliases_of_popular(s, d):
    a = table(s, d, "entity_aliases")
    popular = a.filter("canonical_id is not null").groupBy("canonical_id").count().orderBy(F.desc("count"), "canonical_id").first()
    return resolve.aliases_of(a, popular["canonical_id"] if popular else "")


@q(
    "SELECT canonical_id, alias_id, phase::INT AS phase FROM entity_aliases a WHERE NOT EXISTS (SELECT 1 FROM entity_aliases b WHERE b.phase = 1 AND "
    "a.canonical_id = b.canonical_id AND a.alias_id = b.alias_id)"
)
def alias_append(s, d):
    a = table(s, d, "entity_aliases")
    return resolve.new_aliases(a.filter("phase = 1"), a).select("canonical_id", "alias_id", "phase")


@q(
    "WITH k AS (SELECT id, min(kind) AS kind FROM entities GROUP BY 1) SELECT alias_id AS subject, canonical_id AS object, coalesce(x.kind, 'concept') AS "
    "source_kind, coalesce(y.kind, 'concept') AS target_kind, 'entity resolution merge via ' || coalesce(method, 'null') || ' (confidence=' || CASE WHEN "
    "confidence IS NULL THEN 'null' ELSE CAST(CAST(CAST(confidence AS VARCHAR) AS DECIMAL(18, 3)) AS VARCHAR) END || ')' AS evidence, CASE WHEN "
    "confidence IS NULL THEN 0.0 ELSE least(1.0, greatest(0.0, confidence)) END AS confidence FROM entity_aliases LEFT JOIN k x ON x.id = alias_id LEFT "
    "JOIN k y ON y.id = canonical_id"
)
def same_as_edges(s, d):
    return (
        resolve.same_as_edges(table(s, d, "entity_aliases"), table(s, d, "entities"), "2026-01-01T00:00:00+00:00")
        .select("subject", "object", "source_kind", "target_kind", "evidence", "confidence")
    )


@q("SELECT phase::INT AS phase, count(*) AS n FROM entity_aliases GROUP BY 1 UNION ALL SELECT NULL, count(*) FROM entity_aliases")
def alias_stats(s, d):
    return resolve.alias_stats(table(s, d, "entity_aliases"))


@q("""WITH RECURSIVE p AS (SELECT alias_id AS id, min(canonical_id) AS nx FROM entity_aliases WHERE alias_id IS NOT NULL AND canonical_id IS NOT NULL AND alias_id <> canonical_id GROUP BY 1),
u AS (SELECT id, nx AS spot FROM p UNION SELECT u.id, p.nx FROM u JOIN p ON u.spot = p.id), l AS (SELECT DISTINCT spot FROM u WHERE id = spot)
SELECT id, spot AS canonical FROM u WHERE spot NOT IN (SELECT id FROM p) UNION ALL SELECT id, min(spot) FROM u WHERE spot IN (SELECT spot FROM l) GROUP BY id""")
def canonical_map(s, d):
    return resolve.canonical_map(table(s, d, "entity_aliases"))


# --- vectors -----------------------------------------------------------------------------------


@q(f"""WITH r AS (SELECT subject, row_number() OVER (PARTITION BY subject ORDER BY confidence DESC NULLS LAST, triple_id, row_id) AS rn, predicate, concat_ws(' | ', predicate || ': ' || object, CASE WHEN length(evidence) > 10 THEN evidence[:120] END) AS p FROM triples),
t AS (SELECT subject, string_agg(p, ' | ' ORDER BY rn) AS p FROM r WHERE rn <= 8 AND coalesce(predicate, '') NOT IN {_in(UNSERIALISED)} AND p <> '' GROUP BY 1) SELECT id, concat_ws(' | ', id, p) AS text FROM (SELECT DISTINCT id FROM entities WHERE id IS NOT NULL) LEFT JOIN t ON id = subject""")
def entity_text(s, d):
    return vectors.entity_texts(triples(s, d), table(s, d, "entities"))


def _vectors(s, d) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").alias("grp"))


_COS = "list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[])"


def _near(extra: str) -> str:
    return f"SELECT query, id, round(score, 6) AS score, rn::INT AS rank FROM (SELECT x.vec_id AS query, y.vec_id AS id, {_COS} AS score, row_number() OVER (PARTITION BY x.vec_id ORDER BY round({_COS}, 9) DESC, y.vec_id) AS rn FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id{extra} WHERE x.vec_id % 50 = 0) WHERE rn <= 10"


@q(_near(""))
def knn_top10(s, d):
    v = _vectors(s, d)
    return vectors.nearest(v, v.filter("id % 50 = 0")).withColumn("score", F.round("score", 6))


@q(_near(" AND x.label = y.label"))
def knn_same_kind(s, d):
    v = _vectors(s, d)
    return vectors.nearest(v, v.filter("id % 50 = 0"), same_group=True).withColumn("score", F.round("score", 6))


_ASKED = "SELECT count(*) AS queries, 10 * count(*) AS rows, true AS recall_reached FROM embeddings WHERE vec_id % 50 = 0"


@q(_ASKED)
def knn_quantised_holds(s, d):
    """4-bit search with exact ranking: at least nine tenths of the true neighbours."""
    v = _vectors(s, d)
    asked = v.filter("id % 50 = 0")
    found = materialise(vectors.nearest(v, asked, quantised=True), "found")
    true = vectors.nearest(v, asked).select("query", "id")
    hits = found.join(true, ["query", "id"], "left_semi").count()
    n = asked.count()
    return s.createDataFrame([(n, found.count(), hits >= 0.9 * 10 * n)], "queries long, rows long, recall_reached boolean")


@q(_near(""))
def knn_indexed_all_cells(s, d):
    """The index holds every row: with every cell probed it finds what brute force finds."""
    v, path = _vectors(s, d).drop("grp"), scratch_folder(s, "index")
    index.build(v).save(path)
    i = index.VectorIndex.load(s, path)
    return i.search(v.filter("id % 50 = 0"), 10, len(i.centroids)).withColumn("score", F.round("score", 6))


@q(_ASKED)
def knn_index_holds(s, d):
    """With the probes that the index chose: at least nine tenths of the true neighbours."""
    v = _vectors(s, d).drop("grp")
    i = index.build(v)
    i.rows = materialise(i.rows, "cells")
    asked = v.filter("id % 50 = 0")
    return s.createDataFrame([(asked.count(), i.search(asked).count(), i.recall(asked) >= 0.9)], "queries long, rows long, recall_reached boolean")


def _chain(s, d) -> DataFrame:
    """A graph over the vectors: a chain, and hubs (each vector with the one whose number is its label)."""
    e = (
        table(s, d, "embeddings")
        .select(F.explode(F.array(F.struct(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b")), F.struct(F.col("vec_id").alias("a"), F.col("label").cast("long").alias("b")))).alias("e"))
        .select("e.*")
        .filter("a <> b")
    )
    ids = table(s, d, "embeddings").select(F.col("vec_id").alias("b"))
    e = e.join(ids, "b", "left_semi").select(F.least("a", "b").cast("string").alias("a"), F.greatest("a", "b").cast("string").alias("b")).distinct()
    return e.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(e.select("b", "a"))


def _text_vectors(s, d) -> DataFrame:
    return _vectors(s, d).select(F.col("id").cast("string").alias("id"), "vec")


@q("""WITH e AS (SELECT vec_id AS a, vec_id + 1 AS b FROM embeddings UNION ALL SELECT vec_id, label FROM embeddings), g AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM e WHERE a <> b AND b IN (SELECT vec_id FROM embeddings)),
s AS (SELECT a AS id, b AS o FROM g UNION ALL SELECT b, a FROM g), x AS (SELECT id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM s JOIN embeddings ON o = vec_id)
SELECT id::VARCHAR AS id, i::INT AS i, round(avg(v), 6) AS mean FROM x GROUP BY 1, 2""")
def neighbour_mean(s, d):
    return (
        vectors.neighbour_means(_text_vectors(s, d), _chain(s, d))
        .select("id", F.posexplode("mean").alias("i", "mean"))
        .withColumn("mean", F.round("mean", 6))
    )


_GRAPH = """e AS (SELECT vec_id AS a, vec_id + 1 AS b FROM embeddings UNION ALL SELECT vec_id, label FROM embeddings), g AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM e WHERE a <> b AND b IN (SELECT vec_id FROM embeddings)),
s AS (SELECT a AS id, b AS o FROM g UNION ALL SELECT b, a FROM g), x AS (SELECT id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM s JOIN embeddings ON o = vec_id),
m AS (SELECT id, i, avg(v) AS mean FROM x GROUP BY 1, 2)"""


@q(f"""WITH {_GRAPH}, w AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
r AS (SELECT w.id, w.i, CASE WHEN mean IS NULL THEN v ELSE greatest(v + 0.5 * mean, 0) END AS r FROM w LEFT JOIN m ON w.id = m.id AND w.i = m.i), n AS (SELECT id, sqrt(sum(r * r)) AS norm FROM r GROUP BY 1)
SELECT r.id::VARCHAR AS id, r.i::INT AS i, round(r / CASE WHEN norm > 0 THEN norm ELSE 1 END, 4) AS value FROM r JOIN n ON r.id = n.id""")
def sage_layer(s, d):
    """One layer whose weights take the own vector and half the neighbours' mean."""
    v = _text_vectors(s, d)
    first = v.first()
    one_ = np.eye(len(first["vec"]) if first else 1)
    out = vectors.aggregate(v, _chain(s, d), np.hstack([one_, one_ / 2]), layers=1)
    return out.select("id", F.posexplode("vec").alias("i", "value")).withColumn("value", F.round(F.col("value").cast("double"), 4))


@q(
    f"WITH e AS ({_NOISE}), n AS (SELECT count(*) AS n FROM (SELECT a FROM e UNION SELECT b FROM e)) SELECT (n * greatest(1, least(50, 200 // greatest(n, "
    f"1))) * 5)::BIGINT AS steps, true AS along_edges FROM n"
)
def walk_pairs_hold(s, d):
    """Walks of five steps from every node, each along an edge."""
    adj = materialise(vectors.adjacency(triples(s, d), table(s, d, "entities")), "adjacency")
    w = materialise(vectors.walk_pairs(adj), "walks")
    off = w.join(adj, ["src", "dst"], "left_anti").count()
    return w.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("steps")).withColumn("along_edges", F.lit(off == 0))


@q("SELECT count(DISTINCT id) AS entities, true AS unit_length, true AS loss_fell FROM entities")
def embed_entities(s, d):
    """All entities: encoded, the aggregator trained for thirty epochs, applied twice."""
    t, e = triples(s, d), table(s, d, "entities")
    encoder = vectors.NGramEncoder()
    base = materialise(vectors.encode(vectors.entity_texts(t, e), "text", encoder).select("id", "vec"), "base")
    adj = materialise(vectors.adjacency(t, e), "adjacency")
    w, losses = vectors.train(base, adj, 30)
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    unit = F.coalesce(F.sum(((norm < 0.999) | (norm > 1.001)).cast("long")), F.lit(0)) == 0
    return (
        vectors.aggregate(base, adj, w)
        .agg(F.count(F.lit(1)).alias("entities"), unit.alias("unit_length"))
        .withColumn("loss_fell", F.lit(not losses or min(losses) < losses[0]))
    )


@q("SELECT 64 AS rows, 128 AS cols, true AS same")
def weights_kept(s, d):
    w, path = vectors.initial_weights(64), scratch_folder(s, "weights")
    vectors.save_weights(s, path, w)
    back = vectors.load_weights(s, path, 64)
    same = back is not None and bool((back == w).all()) and vectors.load_weights(s, path, 32) is None and vectors.load_weights(s, path + "-none", 64) is None
    return s.createDataFrame([(*back.shape, same)], "rows int, cols int, same boolean")


@q("SELECT min(id) AS id, 1 AS rank, 1.0::DOUBLE AS score FROM entities")
def text_search_self(s, d):
    """An entity's own text finds the entity."""
    e = vectors.NGramEncoder()
    texts = materialise(vectors.entity_texts(triples(s, d), table(s, d, "entities")), "texts")
    v = materialise(vectors.encode(texts, "text", e), "vectors")
    own = texts.orderBy("id").first()
    return retrieval.search_text(v, own["text"], e).filter("rank = 1").select("id", "rank", F.round("score", 4).alias("score"))


# --- communities and retrieval -----------------------------------------------------------------


@q(
    f"SELECT least(subject, object) AS a, greatest(subject, object) AS b, sum(CASE WHEN predicate IN {_in(STRONG_PREDICATES)} THEN 2.0 ELSE 1.0 "
    f"END)::DOUBLE AS weight FROM triples WHERE predicate IN {_in(SEMANTIC_PREDICATES)} AND subject <> object AND subject <> '' AND object <> '' GROUP BY "
    f"1, 2"
)
def semantic_edge_weights(s, d):
    return com.semantic_edges(triples(s, d))


@q("SELECT true AS found, true AS large_enough, true AS one_place_a_level, true AS within_parent, true AS connected, true AS no_gain_left")
def communities_hold(s, d):
    """What a detection must keep: sizes, one community an entity and level, children inside parents, connected
    communities, and on level 0 no entity that would be better in a neighbouring community."""
    edges = materialise(com.semantic_edges(triples(s, d)), "edges")
    found = materialise(com.hierarchy_levels(edges, min_size=1), "levels")
    kept = materialise(com.large_enough(found), "kept")  # both sizes split communities of over six: one detection serves both
    sizes = kept.groupBy("community").count().agg(F.min("count"), F.count(F.lit(1))).first()
    twice = found.groupBy("level", "entity").count().filter("count > 1").count()
    above = found.select(F.col("community").alias("parent"), "entity")
    outside = found.filter("parent is not null").join(above, ["parent", "entity"], "left_anti").count()
    place = found.filter("level = 0").select(F.col("entity").alias("v"), F.col("community").alias("c"))
    pa, pb = place.select(F.col("v").alias("a"), F.col("c").alias("ca")), place.select(F.col("v").alias("b"), F.col("c").alias("cb"))
    placed = materialise(edges.join(pa, "a").join(pb, "b"), "placed")
    pieces = (
        graph.components(placed.filter("ca = cb"))
        .join(place.withColumnRenamed("v", "id"), "id")
        .groupBy("c")
        .agg(F.countDistinct("root").alias("n"))
        .filter("n > 1")
        .count()
    )
    both = placed.select(F.col("a").alias("v"), F.col("ca").alias("own"), F.col("cb").alias("to"), "weight").union(placed.select("b", "cb", "ca", "weight"))
    links = both.groupBy("v", "own", "to").agg(F.sum("weight").alias("k"))
    degree = both.groupBy("v", "own").agg(F.sum("weight").alias("d"))
    total = degree.groupBy(F.col("own").alias("to")).agg(F.sum("d").alias("s"))
    m2 = degree.agg(F.sum("d")).first()[0] or 1.0
    here = links.filter("own = to").select("v", F.col("k").alias("kept"))
    mine = (
        degree.join(total.select(F.col("to").alias("own"), F.col("s").alias("own_s")), "own")
        .join(here, "v", "left")
        .select("v", "d", (F.coalesce("kept", F.lit(0.0)) - F.col("d") * (F.col("own_s") - F.col("d")) / m2).alias("g0"))
    )
    better = links.filter("own <> to").join(total, "to").join(mine, "v").filter(F.col("k") - F.col("d") * F.col("s") / m2 > F.col("g0") + 1e-6)
    # communities that contracted levels joined keep every entity's gain only as a whole, so few may be left
    gains = better.select("v").distinct().count() <= 0.05 * place.count()
    return s.createDataFrame(
        [((sizes[1] or 0) > 0, (sizes[0] or 0) >= 3, twice == 0, outside == 0, pieces == 0, gains)],
        "found boolean, large_enough boolean, one_place_a_level boolean, within_parent boolean, connected boolean, no_gain_left boolean",
    )


def _first_line(prompt: str, system: str) -> str:
    return prompt.split("\n")[0]


@q(f"""WITH m AS (SELECT DISTINCT community_id, entity_id FROM community_members), n AS (SELECT community_id, count(*) AS n FROM m GROUP BY 1),
o AS (SELECT community_id, entity_id FROM m QUALIFY row_number() OVER (PARTITION BY community_id ORDER BY entity_id NULLS FIRST) <= 20), l AS (SELECT community_id, string_agg(entity_id, ', ' ORDER BY entity_id) AS names FROM o GROUP BY 1),
f AS (SELECT DISTINCT community_id FROM m JOIN (SELECT subject AS id FROM triples WHERE predicate NOT IN {_in(NOISE_PREDICATES)} UNION SELECT object FROM triples WHERE predicate NOT IN {_in(NOISE_PREDICATES)}) ON id = entity_id)
SELECT n.community_id, CASE WHEN f.community_id IS NULL THEN '' ELSE 'Community ' || n.community_id || ', ' || n || ' entities: ' || names END AS summary FROM n JOIN l ON n.community_id = l.community_id LEFT JOIN f ON n.community_id = f.community_id WHERE n.community_id IS NOT NULL""")
def community_summaries(s, d):
    """A client that answers with the prompt's first line: a community's size and first members."""
    m = table(s, d, "community_members").select("community_id", "entity_id")
    return com.summarise(com.community_facts(triples(s, d), m), m, _first_line)


@q("SELECT count(*) AS communities, coalesce(sum(member_count), 0)::BIGINT AS total_members FROM communities")
def community_stats(s, d):
    return com.community_stats(table(s, d, "communities"))


_REGIONS = "WITH a AS (SELECT n_regionkey AS r, min(n_name) AS head FROM nation GROUP BY 1)"


def _neighbours(s, d) -> DataFrame:
    """Nations: strong links within a region, and one from each region's first nation to the next region's."""
    n = table(s, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("r"))
    m = n.select(F.col("name").alias("other"), "r")
    inner = n.join(m, "r").filter("name < other").select(F.col("name").alias("a"), F.col("other").alias("b"), F.lit(2.0).alias("weight"))
    heads = n.groupBy("r").agg(F.min("name").alias("h"))
    bridges = (
        heads.join(heads.select((F.col("r") - 1).alias("r"), F.col("h").alias("g")), "r")
        .select(F.least("h", "g").alias("a"), F.greatest("h", "g").alias("b"), F.lit(1.0).alias("weight"))
    )
    return inner.union(bridges)


@q(f"{_REGIONS} SELECT n_name AS v, head AS c FROM nation JOIN a ON n_regionkey = r")
def communities_of_regions(s, d):
    """The communities of a graph in which they are known."""
    return com.partition(_neighbours(s, d).select(F.lit("").alias("scope"), "a", "b", "weight")).select("v", "c")


@q(
    f"{_REGIONS}, n AS (SELECT head, count(*) AS n FROM nation JOIN a ON n_regionkey = r GROUP BY 1) SELECT 0 AS level, 'L0:' || head AS community_id, n "
    f"AS member_count, NULL::VARCHAR AS parent_community_id, 'Community L0:' || head || ', ' || n || ' entities: ' || (SELECT string_agg(n_name, ', ' "
    f"ORDER BY n_name) FROM nation JOIN a ON n_regionkey = r WHERE a.head = n.head) AS summary FROM n"
)
def communities_stored(s, d):
    """Detected, summarised and stored by the engine."""
    e = Engine(s, scratch_folder(s, "graph"))
    fact = (
        _neighbours(s, d)
        .select(F.col("a").alias("subject"), F.when(F.col("weight") > 1, "SIMILAR_TO").otherwise("LINKS_TO").alias("predicate"), F.col("b").alias("object"), F.lit("k").alias("source_kind"), F.lit("k").alias("target_kind"), F.lit(0.9).alias("confidence"))
    )
    e.store.add(fact)
    e.communities(_first_line, max_levels=0)
    return e.table("communities").select("level", "community_id", "member_count", "parent_community_id", "summary")


@q(
    "SELECT community_id, level, member_count, summary, row_number() OVER (PARTITION BY level ORDER BY member_count DESC, community_id, created_at) AS "
    "place FROM communities WHERE summary IS NOT NULL AND summary <> ''"
)
def summaries_order(s, d):
    c = com.summaries(table(s, d, "communities"))
    return c.select(
        "community_id", "level", "member_count", "summary",
        F.row_number().over(Window.partitionBy("level").orderBy(F.desc("member_count"), "community_id", "created_at")).cast("long").alias("place"),
    )


@q(f"""WITH t AS (SELECT DISTINCT subject, predicate, object FROM triples WHERE predicate NOT IN {_in(NOISE_PREDICATES)}), m AS (SELECT DISTINCT community_id, entity_id FROM community_members WHERE entity_id IS NOT NULL),
x AS (SELECT community_id, subject, predicate, object FROM t JOIN m ON subject = entity_id UNION SELECT community_id, subject, predicate, object FROM t JOIN m ON object = entity_id)
SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY community_id ORDER BY predicate, subject, object) <= 80""")
def community_facts_top80(s, d):
    return com.community_facts(triples(s, d), table(s, d, "community_members"))


@q("""WITH s AS (SELECT community_id, 'members: ' || count(DISTINCT entity_id) AS said FROM community_members GROUP BY 1)
SELECT community_id, level, coalesce(said, summary) AS summary FROM communities LEFT JOIN s USING (community_id)""")
def summaries_updated(s, d):
    n = table(s, d, "community_members").groupBy("community_id").agg(F.countDistinct("entity_id").alias("n"))
    said = n.select("community_id", F.concat(F.lit("members: "), F.col("n").cast("string")).alias("summary"))
    return com.with_summaries(table(s, d, "communities"), said).select("community_id", "level", "summary")


_RT = retrieval.ranking_terms(QUESTION)
_AT = retrieval.anchor_terms(QUESTION)
_SCORE = "(" + " + ".join(f"contains(lower(summary), '{t}')::INT" for t in sorted(set(_RT))) + f")::DOUBLE / {len(set(_RT))}"


@q(
    f"SELECT community_id, level, member_count, summary, round({_SCORE}, 6) AS score FROM communities WHERE summary IS NOT NULL AND summary <> '' ORDER BY "
    f"round({_SCORE}, 9) DESC, level, member_count DESC, community_id, summary LIMIT 20"
)
def rank_communities_keyword(s, d):
    return (
        retrieval.rank_communities(table(s, d, "communities"), QUESTION)
        .select("community_id", "level", "member_count", "summary", F.round("score", 6).alias("score"))
    )


@q(f"""WITH t AS (SELECT community_id, row_number() OVER (ORDER BY round({_SCORE}, 9) DESC, level, member_count DESC, community_id, summary) AS pos FROM communities WHERE summary IS NOT NULL AND summary <> '' QUALIFY pos <= 3),
m AS (SELECT DISTINCT pos, entity_id AS id FROM community_members JOIN t USING (community_id) WHERE entity_id IS NOT NULL)
SELECT pos::INT AS pos, row_number() OVER (PARTITION BY pos ORDER BY id)::INT AS rn, id FROM m QUALIFY rn <= 10""")
def member_anchors_top(s, d):
    return retrieval.member_anchors(retrieval.rank_communities(table(s, d, "communities"), QUESTION), table(s, d, "community_members"))


_TERMS = "w AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(_AT)) + ") AS v(term_no, term))"
_ANCHORS = f"""WITH {_TERMS}, x AS (SELECT DISTINCT term_no, 0 AS side, id FROM entities JOIN w ON contains(lower(id), term) UNION ALL SELECT DISTINCT term_no, 1, subject FROM triples JOIN w ON contains(lower(object), term) WHERE {_T}),
a AS (SELECT term_no, side, id, row_number() OVER (PARTITION BY term_no, side ORDER BY id) AS rn FROM x QUALIFY rn <= 10)"""


@q(f"{_ANCHORS} SELECT term_no, side, id, rn::INT AS rn FROM a")
def anchors_lexical(s, d):
    return retrieval.lexical_anchors(table(s, d, "entities"), triples(s, d), _AT)


@q(
    f"{_ANCHORS}, o AS (SELECT id, min((term_no, side, rn)) AS o FROM a GROUP BY 1) SELECT id, (row_number() OVER (ORDER BY o) - 1)::INT AS pos FROM o "
    f"ORDER BY o LIMIT 20"
)
def anchors_merged(s, d):
    return retrieval.anchors(table(s, d, "entities"), triples(s, d), QUESTION)


_FOLLOWED = f"""{_ANCHORS.replace("WITH ", "WITH RECURSIVE ", 1)}, p AS (SELECT alias_id AS id, min(canonical_id) AS nx FROM entity_aliases WHERE alias_id IS NOT NULL AND canonical_id IS NOT NULL AND alias_id <> canonical_id GROUP BY 1),
u AS (SELECT id, nx AS spot FROM p UNION SELECT u.id, p.nx FROM u JOIN p ON u.spot = p.id), l AS (SELECT DISTINCT spot FROM u WHERE id = spot),
k AS (SELECT id, spot AS canonical FROM u WHERE spot NOT IN (SELECT id FROM p) UNION ALL SELECT id, min(spot) FROM u WHERE spot IN (SELECT spot FROM l) GROUP BY id),
o AS (SELECT coalesce(canonical, a.id) AS id, min((term_no, side, rn)) AS o FROM a LEFT JOIN k ON a.id = k.id GROUP BY 1),
n AS (SELECT id, (row_number() OVER (ORDER BY o) - 1)::INT AS pos FROM o ORDER BY o LIMIT 20)"""


@q(f"{_FOLLOWED} SELECT id, pos FROM n")
def anchors_canonical(s, d):
    return retrieval.anchors(table(s, d, "entities"), triples(s, d), QUESTION, table(s, d, "entity_aliases"))


_FACT = (
    "'(' || subject || ')-[' || predicate || ']->(' || object || ')' || CASE WHEN confidence < 0.9 THEN ' [conf=' || CAST(CAST(CAST(confidence AS "
    "VARCHAR) AS DECIMAL(18, 2)) AS VARCHAR) || ']' ELSE '' END || CASE WHEN evidence <> '' THEN '  // ' || evidence[:80] ELSE '' END"
)


@q(
    f"SELECT row_number() OVER (ORDER BY confidence DESC NULLS LAST, predicate, subject, object, triple_id, evidence)::INT AS place, {_FACT} AS fact FROM "
    f"triples WHERE coalesce(predicate, '') NOT IN {_in(UNSERIALISED)} ORDER BY place LIMIT 200"
)
def serialise_facts(s, d):
    return retrieval.serialise(triples(s, d))


def _ask(s, d, mode: str) -> DataFrame:
    r = (
        retrieval.Retriever(triples(s, d), table(s, d, "entities"), table(s, d, "communities"), table(s, d, "community_members"), table(s, d, "entity_aliases"))
        .ask(QUESTION, mode)
    )
    return s.createDataFrame(
        [(r["mode"], r["answer"], int(r["subgraph_size"]), r["anchor_entities"], int(r.get("communities_used", 0)))],
        "mode string, answer string, subgraph_size int, anchors array<string>, communities_used int",
    )


_TOP = (
    f"SELECT member_count FROM communities WHERE summary IS NOT NULL AND summary <> '' ORDER BY round({_SCORE}, 9) DESC, level, member_count DESC, "
    f"community_id, summary LIMIT 20"
)


@q(f"{_FOLLOWED} SELECT 'local' AS mode, 0 AS communities_used, (SELECT list(id ORDER BY pos) FROM n) AS anchors")
def ask_local(s, d):
    return _ask(s, d, "local").select("mode", "communities_used", "anchors")


@q(f"SELECT 'global' AS mode, sum(member_count)::INT AS subgraph_size, count(*)::INT AS communities_used FROM ({_TOP})")
def ask_global(s, d):
    return _ask(s, d, "global").select("mode", "subgraph_size", "communities_used")


@q(f"{_FOLLOWED} SELECT 'drift' AS mode, (SELECT count(*) FROM ({_TOP}))::INT AS communities_used, (SELECT list(id ORDER BY pos) FROM n) AS anchors")
def ask_drift(s, d):
    return _ask(s, d, "drift").select("mode", "communities_used", "anchors")


@q("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS in_window FROM events")
def rate_window_60s(s, d):
    return rate_window(table(s, d, "events"), "user_id", "ts").select("event_id", "in_window")


