"""Adapters of one's own, embeddings in resolution, clients, limits, and where scratch tables may lie."""

import http.server
import json
import threading
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from tripleloom import engine, session
from tripleloom.clients import HttpClient
from tripleloom.engine import Engine
from tripleloom.operators import resolve
from tripleloom.operators.vectors import NGramEncoder
from tripleloom.schema import Vocabulary
from tripleloom.sources import files


@dataclass
class TableAdapter:
    """Documents are rows of a table: each names a pair."""

    vocabulary: Vocabulary = Vocabulary("pairs", ("LINKS_TO",), ("thing",), ("thing",))

    def scan(self, spark, source, **filters):
        return spark.read.parquet(source)

    def extract(self, documents):
        kind = F.lit("thing")
        return documents.select(F.col("a").alias("subject"), F.lit("LINKS_TO").alias("predicate"), F.col("b").alias("object"), kind.alias("source_kind"), kind.alias("target_kind"), F.lit(0.9).alias("confidence"), F.lit("table").alias("source_doc"))


def test_an_adapter_of_ones_own(spark, tmp_path):
    spark.createDataFrame([("x", "y"), ("y", "z"), ("x", "y")], "a string, b string").write.parquet(str(tmp_path / "t"))
    e = Engine(spark, str(tmp_path / "g"))
    r = e.ingest(str(tmp_path / "t"), TableAdapter())
    assert (r.adapter, r.scanned, r.added, r.skipped) == ("pairs", 3, 2, 1)
    engine.register("pairs", TableAdapter())
    try:
        assert e.ingest(str(tmp_path / "t"), "pairs").skipped == 3
    finally:
        del engine.ADAPTERS["pairs"]
    with pytest.raises(TypeError):
        engine.register("no", object())
    with pytest.raises(ValueError):
        e.ingest(str(tmp_path / "t"), "pairs")


SAME = [
    ("Graph Neural Network", "graph-neural-network"), ("Graph Neural Network", "GNN"), ("Knowledge Base", "knowledge bases"), ("Random Walk", "Random Walks"), ("Entity Resolution", "Entity  Resolution"),
    ("Community Detection", "community detections"), ("Label Propagation", "Label-Propagation"), ("Matrix Factorisation", "Matrix Factorization"), ("Semantic Index", "semantic indices"), ("Vector Store", "VectorStore"),
]
APART = [("Graph Neural Network", "Graph Neural Networth"), ("Random Walk", "Random Forest"), ("Entity Resolution", "Entity Recognition"), ("Knowledge Base", "Knowledge Graph"), ("Label Propagation", "Label Smoothing"), ("Matrix Factorisation", "Matrix Completion"), ("Vector Store", "Vector Space"), ("Semantic Index", "Semantic Web"), ("Community Detection", "Commodity Detection"), ("GNN", "GAN")]


def test_resolution_with_embeddings_keeps_its_quality(spark):
    labelled = spark.createDataFrame([(a, b, True) for a, b in SAME] + [(a, b, False) for a, b in APART[1:]], "id_a string, id_b string, same boolean")
    ids = sorted({x for p in SAME + APART[1:] for x in p})
    entities = spark.createDataFrame([(i, "concept") for i in ids], "id string, kind string")
    none = spark.createDataFrame([], "subject string, predicate string, object string")
    by_name = resolve.pair_quality(labelled, resolve.resolve(entities, none)["canonical"]).first()
    mixed = resolve.pair_quality(labelled, resolve.resolve(entities, none, encoder=NGramEncoder())["canonical"]).first()
    assert mixed["f1"] >= 0.85 and mixed["precision"] >= by_name["precision"]


def test_cosine_decides_against_brute_force(spark):
    from tripleloom.functions.naming import jaro_winkler_value

    ids = ["alpha beta", "alpha betas", "beta alpha", "alpha gamma", "alpna beta", "omega"]
    entities = spark.createDataFrame([(i, "c") for i in ids], "id string, kind string")
    e = NGramEncoder(64)
    got = {(r["a"], r["b"]): (round(r["score"], 6), r["band"]) for r in resolve.matches(entities, encoder=e).filter("method = 'string_embedding'").collect()}
    v = dict(zip(ids, e.encode(ids).astype(float), strict=True))
    want = {}
    for a in ids:
        for b in ids:
            if a < b:
                cos = float(v[a] @ v[b])
                s = 0.6 * jaro_winkler_value(a.replace(" ", ""), b.replace(" ", "")) + 0.4 * cos
                if s >= 0.7:
                    want[a, b] = (round(s, 6), "auto" if s >= 0.85 and cos >= 0.9 else "flagged")
    assert {k: (pytest.approx(x, abs=1e-5), y) for k, (x, y) in want.items()} == got and len(want) > 2


def test_limits_of_structured_files():
    every = files.Limits(None, None, None, None)
    table = ("a\n" + "1\n" * 600).encode()
    assert len(files.file_text(".csv", table, every).splitlines()) == 601
    assert len(files.flatten(list(range(80)), every).splitlines()) == 80
    deep = {"a": {"a": {"a": {"a": {"a": {"a": {"a": 1}}}}}}}
    assert files.flatten(deep, every) == ".".join("a" * 7) + ": 1"
    assert files.file_text(".jsonl", b'{"a": 1}\n' * 700, every).count("a: 1") == 700
    assert files.file_text(".json", b"x" * 20_000, every) == "x" * 20_000 and len(files.file_text(".json", b"x" * 20_000)) == 10_000
    assert files.csv_text("a,b\n1,2,3\n\n4\n", ",") == "Columns: a, b\na: 1 | b: 2\na: 4" and files.csv_text("a,b\n", ",") == "" and files.csv_text("", ",") == ""


def test_http_client():
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["content-length"])))
            said = {"content": [{"type": "text", "text": f" {self.headers['x-key']} {body['system']} {body['messages'][0]['content']} "}]} if body["model"] == "m" else {"content": []}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(said).encode())

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    assert HttpClient(url, "m", (("x-key", "k"),))("p", "s") == "k s p" and HttpClient(url, "other")("p", "s") == ""
    server.shutdown()


def test_scratch_tables_need_a_shared_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        conf = {}
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_root(Session())
    Session.conf = {"spark.checkpoint.dir": "hdfs://x/y/"}
    assert session.scratch_root(Session()) == "hdfs://x/y"


def test_discarded_tables_are_gone(spark):
    import os

    t = session.materialise(spark.range(3), "gone")
    path = t._scratch.removeprefix("file://")
    assert os.path.exists(path)
    session.discard(t, None, spark.range(1))
    assert not os.path.exists(path)


def test_the_bound_before_python_loses_no_pair(spark):
    import random

    from tripleloom.functions.naming import jaro_winkler_value, may_reach

    rng = random.Random(3)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randrange(0, 9))) for _ in range(60)]
    df = spark.createDataFrame([(a, b, jaro_winkler_value(a, b)) for a in words for b in words], "a string, b string, jw double")
    for floor in (0.5, 0.7):
        assert df.filter((F.col("jw") >= floor) & (F.col("a") != F.col("b")) & ~may_reach(F.col("a"), F.col("b"), floor)).count() == 0
        assert df.filter(~may_reach(F.col("a"), F.col("b"), floor)).count() > 100
