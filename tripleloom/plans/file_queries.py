"""Queries and oracle SQL of the file sources, the engine's steps, the store and the stream.

The files are written from the table ``nation`` (all its rows) into the shared scratch folder.
"""

from __future__ import annotations

import contextlib
import io
import json
import re
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom import cli
from tripleloom.engine import Engine, FileAdapter
from tripleloom.operators import rules
from tripleloom.operators.store import TripleStore
from tripleloom.operators.vectors import NGramEncoder
from tripleloom.schema import LAYERS, UNIVERSAL
from tripleloom.serve import App
from tripleloom.session import scratch_folder
from tripleloom.sources import files
from tripleloom.sources.tables import table
from tripleloom.streaming.ingest import ingest_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def q(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def write_files(spark: SparkSession, found: dict[str, bytes | str], label: str) -> str:
    """Write a few files below a new scratch folder; its path."""
    root = scratch_folder(spark, label)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name, body in found.items():
        out = fs.create(path(f"{root}/{name}"))
        out.write(bytearray(body.encode() if isinstance(body, str) else body))
        out.close()
    return root


def nations(spark: SparkSession, d: str) -> list[tuple[int, str, int]]:
    """The nations: 25 rows of a fixed table."""
    return [tuple(r) for r in table(spark, d, "nation").orderBy("n_nationkey").select("n_nationkey", "n_name", "n_regionkey").collect()]


def note(k: int, name: str, r: int) -> str:
    return f"# {name}\nLies in [[Region {r}]] and [map](https://www.map{k}.example.org/at) #nation\n"


_NOTE = (
    "'# ' || n_name || chr(10) || 'Lies in [[Region ' || n_regionkey || ']] and [map](https://www.map' || n_nationkey || '.example.org/at) #nation' || "
    "chr(10)"
)


def tree(spark: SparkSession, d: str) -> str:
    """Notes, and what no adapter takes: other suffixes, excluded and hidden folders, an empty file."""
    rows = nations(spark, d)
    found = {f"notes/n{k:02}.md": note(k, n, r) for k, n, r in rows}
    found |= {f"notes/n{k:02}.bin": "x" for k, _, _ in rows} | {f"logs/n{k:02}.md": "# log" for k, _, _ in rows} | {f".cache/n{k:02}.md": "# c" for k, _, _ in rows} | {"notes/none.md": ""}
    return write_files(spark, found, "tree")


_PATH = "'notes/n' || lpad(n_nationkey::VARCHAR, 2, '0') || '.md'"


@q(
    f"SELECT adapter, {_PATH} AS relative_path, 'doc:' || substr(sha256({_PATH}), 1, 16) AS doc_id, octet_length(encode({_NOTE}))::BIGINT AS size_bytes, "
    f"row_number() OVER (PARTITION BY adapter ORDER BY {_PATH}) AS place FROM nation, (VALUES ('universal'), ('vault'), ('vault, notes only')) AS "
    f"a(adapter)"
)
def files_scanned(s, d):
    root = tree(s, d)
    both = files.scan(s, root, "universal").withColumn("adapter", F.lit("universal")).union(files.scan(s, root, "vault").withColumn("adapter", F.lit("vault")))
    both = both.union(files.scan(s, root, "vault", include=["Notes"]).withColumn("adapter", F.lit("vault, notes only")))
    both = files.in_path_order(both.select("adapter", "relative_path", "doc_id", "size_bytes"))
    return s.createDataFrame([(*r, sum(x["adapter"] == r["adapter"] for x in rows[: i + 1])) for rows in [both.collect()] for i, r in enumerate(rows)], "adapter string, relative_path string, doc_id string, size_bytes long, place long")  # 75 files


def docx(rows: list[tuple[int, str, int]]) -> bytes:
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    text = lambda x: f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>"
    cells = "".join(f"<w:tr><w:tc>{text(k)}</w:tc><w:tc>{text(n)}</w:tc></w:tr>" for k, n, _ in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{text("Nations")}<w:tbl>{cells}</w:tbl></w:body></w:document>')
    return out.getvalue()


def structured(rows: list[tuple[int, str, int]]) -> dict[str, bytes | str]:
    """The table in every format that is read."""
    cells = [{"key": k, "name": n, "in": {"region": r, "none": None}} for k, n, r in rows]
    return {
        "nation.csv": "key,name\n" + "".join(f"{k},{n}\n" for k, n, _ in rows),
        "nation.tsv": "key\tname\n" + "".join(f"{k}\t{n}\n" for k, n, _ in rows),
        "nation.json": json.dumps({"rows": cells}),
        "nation.jsonl": "".join(json.dumps(c) + "\n" for c in cells) + "no json\n",
        "nation.yaml": "rows:\n" + "".join(f"  - name: {n}\n    tags: [{r}, x]\n" for _, n, r in rows),
        "nation.html": "<html><head><script>var x</script></head><body><nav>menu</nav>" + "".join(f"<h2>{n}</h2><p>Region {r} <a href='/n{k}'>more</a></p>" for k, n, r in rows) + "<footer>end</footer></body></html>",
        "nation.docx": docx(rows),
        "nation.xml": "".join(f"<n>{n}</n>\n" for _, n, _ in rows),
        "broken.json": '{"a": ',
        "broken.docx": "no archive",
    }


_N = "(SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation)"
_TEXTS = f"""
SELECT 'nation.csv' AS relative_path, 0::BIGINT AS line_no, 'Columns: key, name' AS line UNION ALL SELECT 'nation.csv', i + 1, 'key: ' || n_nationkey || ' | name: ' || n_name FROM {_N}
UNION ALL SELECT 'nation.tsv', 0, 'Columns: key, name' UNION ALL SELECT 'nation.tsv', i + 1, 'key: ' || n_nationkey || ' | name: ' || n_name FROM {_N}
UNION ALL SELECT 'nation.json', 3 * i, 'rows[' || i || '].key: ' || n_nationkey FROM {_N} UNION ALL SELECT 'nation.json', 3 * i + 1, 'rows[' || i || '].name: ' || n_name FROM {_N} UNION ALL SELECT 'nation.json', 3 * i + 2, 'rows[' || i || '].in.region: ' || n_regionkey FROM {_N}
UNION ALL SELECT 'nation.jsonl', 3 * i, 'key: ' || n_nationkey FROM {_N} UNION ALL SELECT 'nation.jsonl', 3 * i + 1, 'name: ' || n_name FROM {_N} UNION ALL SELECT 'nation.jsonl', 3 * i + 2, 'in.region: ' || n_regionkey FROM {_N} UNION ALL SELECT 'nation.jsonl', 3 * count(*), 'no json' FROM nation
UNION ALL SELECT 'nation.yaml', 3 * i, 'rows[' || i || '].name: ' || n_name FROM {_N} UNION ALL SELECT 'nation.yaml', 3 * i + 1, 'rows[' || i || '].tags[0]: ' || n_regionkey FROM {_N} UNION ALL SELECT 'nation.yaml', 3 * i + 2, 'rows[' || i || '].tags[1]: x' FROM {_N}
UNION ALL SELECT 'nation.html', 3 * i, '## ' || n_name FROM {_N} UNION ALL SELECT 'nation.html', 3 * i + 1, 'Region ' || n_regionkey || 'more' FROM {_N} UNION ALL SELECT 'nation.html', 3 * i + 2, '[more](/n' || n_nationkey || ')' FROM {_N}
UNION ALL SELECT 'nation.docx', 0, 'Nations' UNION ALL SELECT 'nation.docx', i + 1, n_nationkey || ' | ' || n_name FROM {_N}
UNION ALL SELECT 'nation.xml', i, '<n>' || n_name || '</n>' FROM {_N}
UNION ALL SELECT 'broken.json', 0, '{{"a": ' UNION ALL SELECT 'broken.docx', 0, ''"""


@q(_TEXTS)
def files_texts(s, d):
    root = write_files(s, structured(nations(s, d)), "tables")
    texts = files.read_texts(files.scan(s, root, "universal"))
    body = F.regexp_replace("text", "\n$", "")
    return texts.select("relative_path", F.posexplode(F.split(body, "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


_REGION = "'Region ' || n_regionkey"
_HOST = "'www.map' || n_nationkey || '.example.org'"
_NOTE_FACTS = [("HAS_FILE_TYPE", "'md'", "'file_type'"), ("CONTAINS_HEADING", "n_name", "'heading:h1'"), ("LINKS_TO", _REGION, "'vault_link'"), ("REFERENCES_URL", _HOST, "'url_host'"), ("HAS_TAG", "'nation'", "'tag'")]
_EXTRACTED = " UNION ALL ".join(f"SELECT {_PATH} AS source_doc, '{p}' AS predicate, {o} AS object, {k} AS target_kind, {i + 1} AS place FROM nation" for i, (p, o, k) in enumerate(_NOTE_FACTS))
_CSV_FACTS = f"""
SELECT 'nation.csv' AS source_doc, 'HAS_FILE_TYPE' AS predicate, 'csv' AS object, 'file_type' AS target_kind, 1 AS place UNION ALL SELECT 'nation.csv', 'HAS_COLUMN', 'key', 'column', 2 UNION ALL SELECT 'nation.csv', 'HAS_COLUMN', 'name', 'column', 3
UNION ALL SELECT 'nation.csv', 'CONTAINS_KEY', 'key=' || n_nationkey || ' | name: ' || n_name, 'key', i::INT + 4 FROM {_N}"""


@q(_EXTRACTED + " UNION ALL " + _CSV_FACTS)
def files_extracted(s, d):
    """Notes and a table by the universal rules; the table gives columns and keys, then its narrative facts (none)."""
    adapter = FileAdapter("universal", UNIVERSAL, rules.FACTS["universal"])
    notes = adapter.extract(adapter.scan(s, tree(s, d)))
    csv = adapter.extract(adapter.scan(s, write_files(s, {"nation.csv": structured(nations(s, d))["nation.csv"]}, "csv")))
    return notes.union(csv).select("source_doc", "predicate", "object", "target_kind", "place")


@q(
    "SELECT 'dry run' AS step, count(*) AS scanned, 0::BIGINT AS extracted, 0::BIGINT AS added, 0::BIGINT AS skipped, 0::BIGINT AS rejected FROM nation "
    "UNION ALL SELECT 'first', count(*), count(*), 5 * count(*), 0, 0 FROM nation UNION ALL SELECT 'again', count(*), count(*), 0, 5 * count(*), 0 FROM "
    "nation"
)
def engine_ingest(s, d):
    e, root = Engine(s, scratch_folder(s, "graph")), tree(s, d)
    steps = [("dry run", e.ingest(root, "vault", dry_run=True)), ("first", e.ingest(root, "vault")), ("again", e.ingest(root, "vault"))]
    return s.createDataFrame(
        [(n, r.scanned, r.extracted, r.added, r.skipped, r.rejected) for n, r in steps],
        "step string, scanned long, extracted long, added long, skipped long, rejected long",
    )


@q(
    f"SELECT 'first: ' || count(*) AS step, count(*) AS files FROM nation UNION ALL SELECT 'broken/n' || lpad(n_nationkey::VARCHAR, 2, '0') || '.docx: "
    f"BadZipFile: File is not a zip file', 1 FROM nation UNION ALL SELECT 'triples', 5 * count(*) + count(*) FROM nation"
)
def ingest_errors(s, d):
    """Files that cannot be read are reported one by one and stop nothing; only the rest gives facts beyond its type."""
    rows = nations(s, d)
    found = {f"notes/n{k:02}.md": note(k, n, r) for k, n, r in rows} | {f"broken/n{k:02}.docx": "no archive" for k, _, _ in rows} | {f"plain/n{k:02}.txt": "words" for k, _, _ in rows}
    e = Engine(s, scratch_folder(s, "graph"))
    r = e.ingest(write_files(s, found, "broken"), "universal")
    return s.createDataFrame(
        [(f"first: {len(r.messages)}", r.scanned - 2 * len(rows)), *((m, 1) for m in r.messages), ("triples", r.added)], "step string, files long",
    )


_ENTITIES = (
    f"SELECT 'doc:' || substr(sha256({_PATH}), 1, 16) AS id FROM nation UNION SELECT 'md' UNION SELECT n_name FROM nation UNION SELECT {_REGION} FROM "
    f"nation UNION SELECT {_HOST} FROM nation UNION SELECT 'nation'"
)


@q(
    f"WITH e AS ({_ENTITIES}), n AS (SELECT count(*) AS n FROM e) SELECT 'first' AS step, n AS encoded, 0::BIGINT AS skipped, n AS stored FROM n UNION ALL "
    f"SELECT 'again', 0, n, n FROM n UNION ALL SELECT 'one more note', 3, n, n + 3 FROM n"
)
def embed_incremental(s, d):
    """Vectors are made for entities without one: a further note brings its id, its heading and a link."""
    e = Engine(s, scratch_folder(s, "graph"), encoder=NGramEncoder(32))
    e.ingest(tree(s, d), "universal")
    steps = [("first", e.embed(epochs=1), e.vectors_table().count()), ("again", e.embed(skip_existing=True), e.vectors_table().count())]
    e.ingest(write_files(s, {"more.md": "# One more heading\nSee [[An unknown thing]] #nation\n"}, "more"), "universal")
    steps.append(("one more note", e.embed(skip_existing=True), e.vectors_table().count()))
    return s.createDataFrame([(n, r["entities"], r.get("skipped", 0), c) for n, r, c in steps], "step string, encoded long, skipped long, stored long")


@q(
    "SELECT path, status FROM (VALUES ('GET /health', 200), ('GET /graph/stats', 200), ('GET /graph/path', 200), ('GET /graph/node', 200), ('GET "
    "/graph/provenance', 200), ('GET /none', 404)) AS v(path, status) UNION ALL SELECT 'triples', (5 * count(*))::INT FROM nation UNION ALL SELECT "
    "'provenance of the tag', count(*)::INT FROM nation"
)
def rest_routes(s, d):
    e = Engine(s, scratch_folder(s, "graph"))
    e.ingest(tree(s, d), "vault")
    app, name = App(e), nations(s, d)[0][1].replace(" ", "%20")
    get = lambda path: app.handle("GET", path)
    stats, shown = get("/graph/stats"), get("/graph/provenance/nation")
    rows = [("GET /health", get("/health")[0]), ("GET /graph/stats", stats[0]), ("GET /graph/path", get(f"/graph/path?from={name}&to=nation")[0]), ("GET /graph/node", get(f"/graph/node/{name}")[0]), ("GET /graph/provenance", shown[0]), ("GET /none", get("/none")[0])]
    triples = stats[1].get("triples", stats[1].get("total_triples"))
    found = next(v for v in shown[1].values() if isinstance(v, list))
    return s.createDataFrame([*rows, ("triples", triples), ("provenance of the tag", len(found))], "path string, status int")


@q(f"""SELECT 'ingest' AS command, 5 * count(*) AS n FROM nation UNION ALL SELECT 'stats', 5 * count(*) FROM nation UNION ALL SELECT 'path', 2 FROM nation WHERE n_nationkey = 0 UNION ALL SELECT 'provenance', count(*) FROM nation
UNION ALL SELECT 'provenance, five', 5 UNION ALL SELECT 'aliases', 0 UNION ALL SELECT 'compact', 1 UNION ALL SELECT 'purge', 5 * count(*) FROM nation UNION ALL SELECT 'stats after', 0""")
def cli_commands(s, d):
    """Commands one after another; what each prints, as one number."""
    kg, root, name = scratch_folder(s, "graph"), tree(s, d), nations(s, d)[0][1]

    def run(*args: str) -> str:
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            cli.main(["--path", kg, *args], s)
        return out.getvalue()

    added = int(re.search(r"(\d+) added", run("ingest", root, "--adapter", "vault"))[1])
    size = lambda *args: len(json.loads(run(*args)))
    rows = [("ingest", added), ("stats", json.loads(run("stats"))["triples"]), ("path", size("path", name, "nation")), ("provenance", size("provenance", "nation")), ("provenance, five", size("provenance", "nation", "--limit", "5")), ("aliases", size("aliases", "nation"))]
    rows += [("compact", json.loads(run("compact"))["batches"]), ("purge", json.loads(run("purge", "source_facts"))["deleted"]), ("stats after", json.loads(run("stats"))["triples"])]
    return s.createDataFrame(rows, "command string, n long")


@q("SELECT 'first' AS step, 5 * count(*) AS triples, 1::BIGINT AS batches FROM nation UNION ALL SELECT 'same texts again', 5 * count(*), 1 FROM nation")
def stream_ingest(s, d):
    """A stream of notes, then the same notes again: nothing is added, nothing is written."""
    root, store = scratch_folder(s, "stream"), TripleStore(s, scratch_folder(s, "graph"))
    rows = s.createDataFrame([(f"d{k}", note(k, n, r), f"notes/n{k:02}.md") for k, n, r in nations(s, d)], "doc_id string, text string, relative_path string")
    steps = []
    for step in ("first", "same texts again"):
        rows.coalesce(1).write.mode("append").parquet(f"{root}/in")
        ingest_stream(s.readStream.schema(rows.schema).parquet(f"{root}/in"), store, f"{root}/offsets", "2024-01-01T00:00:00Z").awaitTermination()
        steps.append((step, store.count(), len(store.batches())))
    return s.createDataFrame(steps, "step string, triples long, batches long")


# --- the store over the triples ----------------------------------------------------------------

_GOOD = (
    "subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL AND confidence BETWEEN 0 AND 1 AND layer IN ('source_facts', "
    "'normalised_triples', 'inferred_relations', 'llm_hypotheses')"
)


def good(s: SparkSession, d: str) -> DataFrame:
    """The rows that a store with checks takes."""
    return (
        table(s, d, "triples")
        .filter("subject is not null and predicate is not null and object is not null")
        .filter(F.col("confidence").between(0, 1) & F.col("layer").isin(LAYERS))
    )


def filled(s: SparkSession, d: str) -> tuple[TripleStore, list[tuple[str, int, int]]]:
    """A store to which the trusted source facts came first, then everything."""
    store, t = TripleStore(s, scratch_folder(s, "graph")), good(s, d)
    return store, [("source facts", *store.add(t.filter("layer = 'source_facts'"), "row_id")), ("all", *store.add(t, "row_id")), ("again", *store.add(t, "row_id"))]


_G = f"g AS (SELECT * FROM triples WHERE {_GOOD}), a AS (SELECT DISTINCT triple_id FROM g WHERE layer = 'source_facts')"


@q(
    f"WITH {_G}, n AS (SELECT count(DISTINCT triple_id) AS d, count(*) AS n FROM g), m AS (SELECT count(DISTINCT triple_id) AS d, count(*) AS n FROM g "
    f"WHERE layer = 'source_facts') SELECT 'source facts' AS step, m.d AS added, m.n - m.d AS skipped FROM m UNION ALL SELECT 'all', n.d - m.d, n.n - n.d "
    f"+ m.d FROM n, m UNION ALL SELECT 'again', 0, n.n FROM n"
)
def store_inserts(s, d):
    return s.createDataFrame(filled(s, d)[1], "step string, added long, skipped long")


# rows in the store: the first of each triple_id, source facts before all others
_STORED = (
    f"{_G}, r AS (SELECT *, CASE WHEN triple_id IN (SELECT triple_id FROM a) THEN 0 ELSE 1 END AS b FROM g), k AS (SELECT * FROM r WHERE b = 1 OR layer = "
    f"'source_facts' QUALIFY row_number() OVER (PARTITION BY triple_id ORDER BY row_id) = 1), e AS (SELECT subject AS id, source_kind AS kind, b, row_id * "
    f"2 AS seq FROM k UNION ALL SELECT object, target_kind, b, row_id * 2 + 1 FROM k), f AS (SELECT id, kind FROM e QUALIFY row_number() OVER (PARTITION "
    f"BY id ORDER BY b, seq) = 1)"
)


@q(f"WITH {_STORED} SELECT triple_id, subject, predicate, object, layer FROM k")
def store_rows(s, d):
    return filled(s, d)[0].triples().select("triple_id", "subject", "predicate", "object", "layer")


@q(f"WITH {_STORED} SELECT id, kind FROM f")
def store_entities(s, d):
    return filled(s, d)[0].entities()


@q(f"WITH {_STORED} SELECT DISTINCT e.id, f.kind, e.kind AS other FROM e JOIN f ON e.id = f.id WHERE e.kind IS DISTINCT FROM f.kind")
def store_kind_conflicts(s, d):
    return filled(s, d)[0].kind_conflicts()


@q(
    f"WITH {_STORED}, x AS (SELECT * FROM k WHERE layer <> 'llm_hypotheses') SELECT 'triples' AS what, count(*) AS n FROM x UNION ALL SELECT 'purged', "
    f"count(*) FROM k WHERE layer = 'llm_hypotheses' UNION ALL SELECT 'entities', count(*) FROM (SELECT subject FROM x UNION SELECT object FROM x) UNION "
    f"ALL SELECT 'batches', 1"
)
def store_purge(s, d):
    store = filled(s, d)[0]
    gone = store.purge("llm_hypotheses")
    st = store.stats()
    return s.createDataFrame(
        [("triples", st["triples"]), ("purged", gone), ("entities", st["entities"]), ("batches", len(store.batches()))], "what string, n long",
    )
