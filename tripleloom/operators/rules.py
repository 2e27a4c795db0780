"""Rule-based triple extraction from texts: native line rules, no Python per row.

Texts are split into lines; every rule gives an array of candidate facts for a line; candidates are
exploded, the first of each (document, predicate, object) is kept in the order of line, rule and
match, and of these the first ``max_facts`` of each document. A document's lines are the only group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleloom.schema import triple_id

# The patterns of the rules and the characters that end a line.
LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
BLANKS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
HEADING = r"(?U)^(#{1,6})\s+(.+?)\s*$"
WIKI_LINK = r"\[\[([^\]|#]+)(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]"
MARKDOWN_LINK = r"\[([^\]]{1,160})\]\(([^)]+)\)"
HASHTAG = r"(?U)(?<![\w/])#([A-Za-z][A-Za-z0-9_-]{1,60})\b"
URL = r"""(?U)https?://([a-zA-Z0-9.-]+\.[a-zA-Z]{2,})(?:[/?#][^\s"'<>]*)?"""
WEB = r"(?i)^https?://(?:[^/?#]*@)?([^/?#:@]+)"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, BLANKS, "")


def lines(texts: DataFrame, doc: str, text: str, *keep: str) -> DataFrame:
    """(doc_id, line_no, line, *keep): the non-blank lines without outer white space."""
    out = texts.filter(F.col(text).isNotNull()).select(F.col(doc).alias("doc_id"), *keep, F.posexplode(F.split(F.col(text), LINE_END)).alias("line_no", "line"))
    return out.withColumn("line", strip(F.col("line"))).filter("line <> ''")


def title(c: Column) -> Column:
    """First letter of every run of letters upper case, the others lower."""
    parts = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1000000)))), "")


def is_caps_heading(c: Column) -> Column:
    """A short line in capitals of at most eight words."""
    return (F.length(c) < 80) & (F.upper(c) == c) & (F.lower(c) != c) & (F.size(F.split(c, r"(?U)\s+")) <= 8)


def _facts(values: Column, make) -> Column:
    """Candidates of one rule: ``make`` gives (predicate, object, kind, evidence, confidence) of a value."""

    def one(v, i):
        p, o, k, e, c = make(v)
        return F.struct(
            i.alias("match"), F.lit(p).alias("predicate"), o.alias("object"), (F.lit(k) if isinstance(k, str) else k).alias("kind"), e.alias("evidence"),
            F.lit(c).alias("confidence"),
        )

    return F.transform(values, one)


def _rules(adapter: str) -> list[Column]:
    """The candidate arrays of a line, in the adapter's order of rules."""
    x = F.col("line")
    level, text = F.regexp_extract(x, HEADING, 1), F.regexp_extract(x, HEADING, 2)
    is_heading = F.length(level) > 0
    one = F.array(x)
    none = F.filter(one, lambda v: F.lit(False))
    n = F.length(level).cast("string")
    heading = _facts(
        F.when(is_heading, one).otherwise(none),
        lambda v: ("CONTAINS_HEADING", strip(text), F.concat(F.lit("heading:h"), n), F.concat(F.lit("H"), n, F.lit(": "), strip(text)), 0.90),
    )
    caps = _facts(F.when(~is_heading & is_caps_heading(x), one).otherwise(none), lambda v: ("CONTAINS_HEADING", title(x), "heading", x, 0.70))
    wiki = _facts(F.regexp_extract_all(x, F.lit(WIKI_LINK), F.lit(1)), lambda v: ("LINKS_TO", strip(v), "vault_link", x, 0.86))
    links = F.transform(
        F.regexp_extract_all(x, F.lit(MARKDOWN_LINK), F.lit(0)),
        lambda m: F.struct(strip(F.regexp_extract(m, MARKDOWN_LINK, 1)).alias("label"), strip(F.regexp_extract(m, MARKDOWN_LINK, 2)).alias("url")),
    )
    web = F.filter(links, lambda m: m["url"].rlike(WEB))

    def host(m):
        return F.lower(F.regexp_extract(m["url"], WEB, 1))

    tags = _facts(F.when(x.startswith("#"), none).otherwise(F.regexp_extract_all(x, F.lit(HASHTAG), F.lit(1))), lambda v: ("HAS_TAG", v, "tag", x, 0.82))
    if adapter == "vault":
        def either(m):
            is_web = m["url"].rlike(WEB)
            return F.struct(is_web.alias("web"), m["label"].alias("label"), m["url"].alias("url"))

        linked = F.transform(F.filter(links, lambda m: m["url"].rlike(WEB) | ((m["url"] != "") & ~m["url"].rlike(SCHEME))), either)
        md = F.transform(
            linked,
            lambda m, i: F.struct(
                i.alias("match"),
                F.when(m["web"], F.lit("REFERENCES_URL_HOST")).otherwise(F.lit("LINKS_TO")).alias("predicate"),
                F.when(m["web"], host(m)).otherwise(F.when(m["label"] != "", m["label"]).otherwise(m["url"])).alias("object"),
                F.when(m["web"], F.lit("url_host")).otherwise(F.lit("local_link")).alias("kind"),
                F.concat(F.lit("Link: "), m["label"]).alias("evidence"),
                F.when(m["web"], F.lit(0.82)).otherwise(F.lit(0.80)).alias("confidence"),
            ),
        )
        return [heading, wiki, md, tags]
    md = _facts(web, lambda m: ("REFERENCES_URL", host(m), "url_host", F.concat(F.lit("Link: "), m["label"]), 0.82))
    bare = _facts(F.regexp_extract_all(x, F.lit(URL), F.lit(1)), lambda v: ("REFERENCES_URL", v, "url_host", x, 0.75))
    return [heading, caps, wiki, md, bare, tags]


def _structured_rules() -> list[Column]:
    """Candidates of a line of flattened structured text: columns, keys."""
    x = F.col("line")
    none = F.filter(F.array(x), lambda v: F.lit(False))
    is_columns = x.startswith("Columns:")
    cols = F.filter(F.transform(F.split(F.substring(x, 9, 1000000), ","), strip), lambda c: c != "")
    columns = _facts(F.when(is_columns, cols).otherwise(none), lambda v: ("HAS_COLUMN", v, "column", x, 0.90))
    at = F.instr(x, ": ")
    key = F.ltrim(strip(F.substring(x, F.lit(1), at - 1)), F.lit("."))
    value = strip(F.substring(x, at + 2, F.lit(1000000)))
    ok = ~is_columns & (at > 0) & ~x.startswith("-") & (key != "") & (value != "") & (F.length(value) < 200)
    keys = _facts(F.when(ok, F.array(x)).otherwise(none), lambda v: ("CONTAINS_KEY", F.concat(key, F.lit("="), value), "key", x, 0.80))
    return [columns, keys]


def candidates(texts: DataFrame, doc: str, text: str, rules: list[Column], *keep: str, base: int = 0) -> DataFrame:
    """(doc_id, line_no, rule, match, predicate, object, kind, evidence, confidence, *keep)."""

    def number(rule: Column, no: int) -> Column:
        return F.transform(
            rule, lambda f: F.struct(F.lit(no).alias("rule"), *[f[c].alias(c) for c in ("match", "predicate", "object", "kind", "evidence", "confidence")]),
        )

    numbered = F.concat(*[number(r, base + i) for i, r in enumerate(rules)])
    got = lines(texts, doc, text, *keep).select("doc_id", "line_no", *keep, F.explode(numbered).alias("f")).select("doc_id", "line_no", *keep, "f.*")
    return got.filter(strip(F.col("object")) != "")


#: Facts of a document that the adapters keep.
FACTS = {"universal": 60, "vault": 40}


def first_facts(found: DataFrame, max_facts: int | None = None, cut: int | None = 240) -> DataFrame:
    """The first of each (document, predicate, object), then the first ``max_facts`` of each document (None: all).

    ``cut``: objects are compared by so many characters, or whole if None; they are stored cut to 240.
    """
    key = F.substring("object", 1, cut) if cut else F.col("object")
    order = ["line_no", "rule", "match"]
    w = Window.partitionBy("doc_id", "predicate", "_k").orderBy(*order)
    kept = found.withColumn("_k", key).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_k")
    d = Window.partitionBy("doc_id").orderBy(*order)
    placed = kept.withColumn("place", F.row_number().over(d))
    return placed if max_facts is None else placed.filter(F.col("place") <= max_facts)


def extract(
    texts: DataFrame, adapter: str = "universal", doc: str = "doc_id", text: str = "text", path: str = "relative_path", structured: str | None = None,
    max_facts: int | None = None,
) -> DataFrame:
    """Triples of texts: subject doc_id, in the adapter's vocabulary, with ``place`` in their document.

    ``structured`` names a boolean column: such texts give columns and keys up to their first blank
    line, then the narrative rules; both under one cap. The file type is the first fact; the cap
    counts it, so it may push the last fact out. Blank texts give no triples.
    """
    cap = max_facts or (60 if adapter == "universal" else 40)
    suffix = F.lower(F.regexp_extract(F.col(path), r"[^/.][^/]*(\.[^./]+)$", 1))
    given = texts.filter(F.coalesce(strip(F.col(text)) != "", F.lit(False))).withColumn("_path", F.col(path)).withColumn("_suffix", F.ltrim(suffix, F.lit(".")))
    if structured:
        head = F.regexp_extract(F.col(text), rf"(?U)^((?:[^\n]*\S[^\n]*(?:\n|$))*)", 1)  # up to the first blank line
        is_s = given.filter(F.col(structured)).withColumn("_head", head)
        tables = first_facts(candidates(is_s, doc, "_head", _structured_rules(), "_path", "_suffix"), cap)
        story = first_facts(candidates(given, doc, text, _rules(adapter), "_path", "_suffix", base=10), cap)
        both = tables.withColumn("part", F.lit(0)).unionByName(story.withColumn("part", F.lit(1)))
        w = Window.partitionBy("doc_id", "predicate", F.substring("object", 1, 240)).orderBy("part", "place")
        both = both.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
        d = Window.partitionBy("doc_id").orderBy("part", "place")
        facts = both.withColumn("place", F.row_number().over(d)).drop("_r", "part")
    else:
        facts = first_facts(candidates(given, doc, text, _rules(adapter), "_path", "_suffix"), cap, 240 if adapter == "universal" else None)
    method = F.when(F.col("rule") < 10, F.lit("structural")).otherwise(F.lit("rule")) if structured else F.lit("rule")
    facts = facts.withColumn("place", F.col("place") + 1).withColumn("method", method)
    if cap is not None:
        facts = facts.filter(F.col("place") <= cap)
    kind = F.when(F.col("_suffix") != "", F.col("_suffix")).otherwise(F.lit("text"))
    types = given.select(
        F.col(doc).alias("doc_id"), "_path", F.lit(1).alias("place"), F.lit("HAS_FILE_TYPE").alias("predicate"), kind.alias("object"),
        F.lit("file_type").alias("kind"), F.concat(F.lit("File: "), "_path").alias("evidence"), F.lit(0.95).alias("confidence"),
        F.lit("rule").alias("method"),
    )
    every = types.unionByName(facts.select("doc_id", "_path", "place", "predicate", "object", "kind", "evidence", "confidence", "method"))
    out = every.select(
        F.col("doc_id").cast("string").alias("subject"), "predicate", F.substring("object", 1, 240).alias("object"), F.lit("document").alias("source_kind"),
        F.col("kind").alias("target_kind"), F.substring("evidence", 1, 700).alias("evidence"), "confidence", F.col("_path").alias("source_doc"),
        F.col("method").alias("extraction_method"), F.lit(adapter).alias("adapter"), F.lit("source_facts").alias("layer"), "place",
    )
    return out.withColumn("triple_id", triple_id())
