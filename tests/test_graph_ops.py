import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripleloom.operators import communities as com
from tripleloom.operators import graph, resolve, retrieval, store, validate, vectors
from tripleloom.schema import TRIPLES, Shape, Vocabulary, conform
from tripleloom.streaming.ingest import ingest_stream, rate_window


def make(spark, rows):
    """Rows (subject, predicate, object[, layer[, confidence]]) as full triples with row_id."""
    full = [(i, r[0], r[1], r[2], r[3] if len(r) > 3 else "source_facts", r[4] if len(r) > 4 else 0.9) for i, r in enumerate(rows)]
    df = spark.createDataFrame(full, "row_id long, subject string, predicate string, object string, layer string, confidence double")
    df = df.withColumn("source_kind", F.lit("concept")).withColumn("target_kind", F.lit("concept")).withColumn("evidence", F.lit("")).withColumn("source_doc", F.lit("d")).withColumn("timestamp", F.lit("2024-01-01T00:00:00Z"))
    return conform(df).withColumn("row_id", F.col("triple_id").substr(1, 0).cast("long")).join(df.select("row_id", "subject", "predicate", "object", "layer").withColumnRenamed("row_id", "rid"), ["subject", "predicate", "object", "layer"]).withColumn("row_id", F.col("rid")).drop("rid")


def test_store_is_idempotent(spark, tmp_path):
    s = store.TripleStore(spark, str(tmp_path / "g"))
    assert s.stats()["triples"] == 0
    t = make(spark, [(f"s{i}", "P", f"o{i}") for i in range(20)])
    assert s.add(t) == (20, 0) and s.add(t) == (0, 20)
    assert s.add(make(spark, [("s1", "P", "o1", "inferred_relations"), ("new", "P", "s1", "llm_hypotheses")])) == (2, 0)
    st = s.stats()
    assert st["entities"] == 41 and st["layers"] == {"source_facts": 20, "inferred_relations": 1, "llm_hypotheses": 1} and st["top_predicates"] == {"P": 22}
    assert s.purge("llm_hypotheses") == 1 and s.purge("llm_hypotheses") == 0
    assert s.entities().filter("id = 'new'").count() == 0 and s.entities().count() == 40
    with pytest.raises(ValueError):
        s.add(make(spark, [("a", "P", "b", "nowhere")]))
    with pytest.raises(ValueError):
        s.add(make(spark, [("a", "P", "b", "source_facts", 1.5)]))


def test_triple_identity(spark):
    a, b = (make(spark, [("a", "P", "b", layer)]).first()["triple_id"] for layer in ("source_facts", "inferred_relations"))
    import hashlib

    assert a == hashlib.sha256(b"a|P|b|d|source_facts").hexdigest()[:24] and a != b
    assert [f.name for f in conform(spark.createDataFrame([("a",)], "subject string")).schema] == TRIPLES.names


def test_query_and_views(spark):
    t = make(spark, [("a", "P", "b"), ("b", "Q", "a"), ("a", "P", "a"), ("c", "P", "d")])
    assert store.query(t, subject="a").count() == 2 and store.query(t, subject="", predicate="P").count() == 3 and store.query(t, limit=1).count() == 1
    assert sorted((r["direction"], r["subject"], r["object"]) for r in store.node_view(t, "a", 5).collect()) == [("in", "a", "a"), ("in", "b", "a"), ("out", "a", "a"), ("out", "a", "b")]
    ents = spark.createDataFrame([("a", "k1")], "id string, kind string")
    assert {r["object"] for r in store.provenance(t, ents, "a").collect()} == {"b", "a"}  # b has no entity row


def test_first_kind_and_conflicts(spark):
    rows = [(2, "a", "late", "b", "k"), (1, "b", "first", "a", "early"), (3, "a", "early", "c", None)]
    t = spark.createDataFrame(rows, "row_id long, subject string, source_kind string, object string, target_kind string")
    assert {r["id"]: r["kind"] for r in store.first_kinds(t, "row_id").collect()} == {"a": "early", "b": "first", "c": None}
    assert sorted(tuple(r) for r in store.kind_conflicts(t, "row_id").collect()) == [("a", "early", "late"), ("b", "first", "k")]


def bfs(edges, start, depth):
    adj = defaultdict(set)
    for a, b in edges:
        adj[a].add(b)
        adj[b].add(a)
    dist, front = {start: 0}, [start]
    for d in range(depth):
        front = [y for x in front for y in adj[x] if y not in dist and not dist.update({y: d + 1})]
    return dist


def test_traversal_against_brute_force(spark):
    rng = random.Random(1)
    edges = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(40)] + [("n0", "n0")]
    t = make(spark, [(a, "P", b) for a, b in dict.fromkeys(edges)]).cache()
    start = spark.createDataFrame([("n0",)], "id string")
    dist = bfs(edges, "n0", 4)
    assert {r["node"]: r["depth"] for r in graph.hop_distances(t, start, 4).collect()} == dist
    two = bfs(edges, "n0", 2)
    assert {(r["subject"], r["object"]) for r in graph.neighbourhood(t, start, 2).collect()} == {(a, b) for a, b in edges if a in two or b in two}
    rows = graph.expand_capped(t, ["n0"], 2)
    assert {(r["subject"], r["object"]) for r in rows} == {(a, b) for a, b in edges if a in two or b in two}
    assert len(graph.expand_capped(t, ["n0"], 2, per_node=2, stop=3)) in (3, 4)
    for target in ("n0", "n7", "n13", "zzz"):
        p = graph.shortest_path(t, "n0", target, 4)
        if target in dist:
            assert len(p) == dist[target]
            at = "n0"
            for e in p:
                at = e["object"] if e["subject"] == at else e["subject"]
            assert at == target
        else:
            assert p is None
    trusted = make(spark, [("a", "P", "b", "llm_hypotheses"), ("a", "P", "c")])
    assert [r["object"] for r in graph.expand_capped(trusted, ["a"])] == ["c"]


def test_components_and_roots(spark):
    rng = random.Random(3)
    pairs = [(f"{'x' * rng.randrange(1, 4)}{rng.randrange(40)}", f"y{rng.randrange(40)}") for _ in range(30)] + [("me", "me"), (None, "a")] + [("hub", f"y{i}") for i in range(5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None:
            a, b = sorted((find(a), find(b)), key=lambda v: (len(v), v))
            root[b] = a
    got = {r["id"]: r["root"] for r in graph.components(spark.createDataFrame(pairs, "a string, b string"), least=graph.shortest_first).collect()}
    assert got == {x: find(x) for x in root}
    assert graph.components(spark.createDataFrame([], "a string, b string")).collect() == []


VOC = Vocabulary("v", ("P", "Q", "R"), ("concept",), ("concept", "thing"), (Shape("P", ("thing",), severity="Info"), Shape("Q", max_count=1, severity="Warning"), Shape("R", min_count=2), Shape("Q", datatype="xsd:int")))


def test_validation(spark):
    t = make(spark, [("a", "P", "x"), ("a", "Q", "1"), ("a", "Q", "2"), ("b", "R", "x"), ("c", "NEW", "x")]).withColumn("object_is_literal", F.col("predicate") == "Q").withColumn("object_datatype", F.when(F.col("object") == "1", "xsd:int"))
    got = {(r["predicate"], r["object"]): [(f["severity"], f["detail"]) for f in r["findings"]] for r in validate.findings(t, VOC).collect()}
    assert got == {
        ("P", "x"): [("Violation", "target kind concept is not allowed")], ("Q", "1"): [("Warning", "2 is more than 1")], ("Q", "2"): [("Warning", "2 is more than 1"), ("Violation", "datatype null is not xsd:int")],
        ("R", "x"): [("Violation", "1 is fewer than 2")], ("NEW", "x"): [("Violation", "unknown predicate NEW")],
    }
    assert validate.validate(t, VOC, strict=True).filter("accepted").count() == 1 and validate.validate(t, VOC).filter("accepted").count() == 5
    assert validate.validate(t, VOC).filter("predicate = 'NEW'").first()["message"] == "SCHEMA VIOLATION (c -NEW-> x): [Violation] unknown predicate NEW"
    assert validate.validate(t.limit(0), VOC).collect() == []


def test_resolution(spark):
    names = ["Deep Walk", "DeepWalk", "deep-walk", "Graph Neural Network", "GNN", "Gradient Boosting", "Gradient Boostng", "Zebra", "---", None]
    e = spark.createDataFrame([(n, "concept") for n in names] + [("deepwalk!", "paper")], "id string, kind string")
    t = make(spark, [("Zebra", "SIMILAR_TO", "Quagga", "llm_hypotheses"), ("Zebra", "P", "GNN")])
    got = resolve.resolve(e, t)
    groups = defaultdict(set)
    for r in got["canonical"].collect():
        groups[r["canonical"]].add(r["id"])
    assert dict(groups) == {"DeepWalk": {"Deep Walk", "DeepWalk", "deep-walk"}, "GNN": {"GNN", "Graph Neural Network"}, "Gradient Boostng": {"Gradient Boosting", "Gradient Boostng"}, "Zebra": {"Zebra", "Quagga"}}
    rows = {r["alias_id"]: (r["canonical_id"], r["phase"], r["method"]) for r in got["aliases"].collect()}
    assert rows["Quagga"] == ("Zebra", 3, "structural_wcc") and rows["Graph Neural Network"][1:] == (2, "initialism") and rows["Deep Walk"][1] == 1
    edges = resolve.same_as_edges(got["aliases"], e, "t").filter("subject = 'Quagga'").first()
    assert (edges["object"], edges["source_kind"], edges["layer"]) == ("Zebra", "concept", "inferred_relations")


def test_candidate_cells_cover_every_pair_once(spark):
    reps = spark.createDataFrame([("k", f"ab{i}", f"ab{i}") for i in range(60)], "kind string, norm string, id string")
    for small, cell in ((1000, 7), (10, 5)):
        p = resolve.candidate_pairs(resolve.blocks(reps, phonetic=False, small=small), cell)
        assert p.count() == 60 * 59 // 2 and p.filter("a >= b").count() == 0


def test_canonical_map_follows_chains_and_loops(spark):
    rows = [("b", "a"), ("c", "b"), ("d", "c"), ("y", "x"), ("z", "y"), ("x", "z"), ("y", "w"), ("q", "q"), (None, "n"), ("m", None)]
    got = {r["id"]: r["canonical"] for r in resolve.canonical_map(spark.createDataFrame(rows, "canonical_id string, alias_id string")).collect()}
    assert got == {"a": "d", "b": "d", "c": "d", "x": "x", "y": "x", "z": "x", "w": "x"}
    assert resolve.canonical_map(spark.createDataFrame([], "canonical_id string, alias_id string")).collect() == []


def toy(spark):
    rng = np.random.default_rng(7)
    ids = list("abcdef")
    v = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=16)]) for i in ids], "id string, vec array<float>")
    e = [("a", "b"), ("b", "c"), ("d", "e")]
    return v, spark.createDataFrame([x for a, b in e for x in ((a, b), (b, a))], "src string, dst string")


def test_aggregator(spark):
    v, adj = toy(spark)
    base = {r["id"]: np.array(r["vec"]) for r in v.collect()}
    means = {r["id"]: np.array(r["mean"]) for r in vectors.neighbour_means(v, adj).collect()}
    assert set(means) == set("abcde") and np.allclose(means["b"], (base["a"] + base["c"]) / 2, atol=1e-6)
    w, losses = vectors.train(v, adj, epochs=12)
    w2, losses2 = vectors.train(v, adj, epochs=12)
    assert losses[-1] < losses[0] and losses == losses2 and np.array_equal(w, w2)
    out = {r["id"]: np.array(r["vec"]) for r in vectors.aggregate(v, adj, w).collect()}
    assert all(abs(np.linalg.norm(x) - 1) < 1e-5 for x in out.values()) and np.allclose(out["f"], base["f"] / np.linalg.norm(base["f"]), atol=1e-6)
    walks = vectors.walk_pairs(adj, 2).collect()
    assert sum(r["n"] for r in walks) == 5 * 2 * 5 and all((r["src"], r["dst"]) in {(x["src"], x["dst"]) for x in adj.collect()} for r in walks)


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(0)
    u, v, neg = rng.normal(size=(4, 6)), rng.normal(size=(4, 6)), rng.normal(size=(3, 6))
    n, w = np.array([1.0, 2, 1, 3]), rng.normal(size=(3, 6))
    g, loss, _ = vectors.gradient(u, v, n, neg, w)
    for i, j in ((0, 0), (1, 3), (2, 5)):
        step = np.zeros_like(w)
        step[i, j] = 1e-6
        slope = (vectors.gradient(u, v, n, neg, w + step)[1] - vectors.gradient(u, v, n, neg, w - step)[1]) / 2e-6
        assert abs(slope - g[i, j]) < 1e-4


def test_adjacency_drops_noise(spark):
    t = make(spark, [("a", "LINKS_TO", "b"), ("a", "HAS_TAG", "c"), ("a", "CONTAINS_KEY", "b"), ("b", "P", "a"), ("a", "P", "a"), ("a", "P", "zz")])
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert sorted(tuple(r) for r in vectors.adjacency(t, ids).collect()) == [("a", "b"), ("b", "a")]


def test_search_recall(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 32))
    df = spark.createDataFrame([(i, [float(y) for y in r], i % 3) for i, r in enumerate(x)] + [(999, None, 0)], "id long, vec array<float>, grp int")
    monkeypatch.setattr(vectors, "DATA_CELL", 150)
    monkeypatch.setattr(vectors, "QUERY_CELL", 6)
    n = x.astype(np.float32) / np.linalg.norm(x.astype(np.float32), axis=1, keepdims=True)
    want = {i: [j for j in np.argsort(-(n[i] @ n.T), kind="stable") if j != i][:10] for i in range(0, 700, 50)}
    got, fast = defaultdict(list), defaultdict(set)
    queries = df.filter("id % 50 = 0")
    for r in vectors.nearest(df, queries).orderBy("query", "rank").collect():
        got[r["query"]].append(r["id"])
    assert dict(got) == want
    for r in vectors.nearest(df, queries, quantised=True).collect():
        fast[r["query"]].add(r["id"])
    assert np.mean([len(fast[i] & set(w)) / 10 for i, w in want.items()]) >= 0.9
    assert all(r["query"] % 3 == r["id"] % 3 for r in vectors.nearest(df, queries, same_group=True).collect())
    assert vectors.nearest(df, queries.limit(0)).collect() == [] and vectors.nearest(df.limit(0), queries).collect() == []


def cliques(spark):
    rows, groups = [], [["a", "b", "c", "d"], ["e", "f", "g", "h"], ["i", "j", "k", "l"], ["m", "n", "o", "p"]]
    for g in groups:
        rows += [(x, "SIMILAR_TO", y) for i, x in enumerate(g) for y in g[i + 1 :]]
    rows += [("d", "LINKS_TO", "e"), ("h", "LINKS_TO", "i"), ("l", "LINKS_TO", "m")]
    return make(spark, rows), groups


def test_communities_find_cliques(spark):
    t, groups = cliques(spark)
    edges = com.semantic_edges(t)
    assert edges.filter("a = 'a' and b = 'b'").first()["weight"] == 2.0 and edges.filter("a = 'd' and b = 'e'").first()["weight"] == 1.0
    levels = com.hierarchy_levels(edges, min_size=2, max_levels=2, split_over=4, base=0.1, step=4.0).cache()
    stats = com.detection_stats(levels).first()
    assert stats["covered"] == 16 and stats["levels"] >= 2
    last = levels.groupBy("entity").agg(F.max("level").alias("level")).join(levels, ["entity", "level"])
    leaf = defaultdict(set)
    for r in last.collect():
        leaf[r["community"]].add(r["entity"])
    assert sorted(map(sorted, leaf.values())) == groups
    parents = {r["parent"] for r in levels.filter("level > 0").collect()}
    assert parents <= {r["community"] for r in levels.collect()}
    c, m = com.community_tables(levels)
    assert com.community_stats(c).first()["total_members"] == m.count()
    flat = com.hierarchy_levels(com.semantic_edges(make(spark, [("a", "LINKS_TO", "b"), ("b", "LINKS_TO", "c"), ("c", "LINKS_TO", "a")])))
    assert {r["entity"] for r in flat.collect()} == {"a", "b", "c"} and flat.select("level").distinct().count() == 1
    assert com.semantic_edges(make(spark, [("a", "HAS_FILE_TYPE", "md")])).collect() == []


def test_summaries(spark):
    t, _ = cliques(spark)
    m = spark.createDataFrame([("c1", "a"), ("c1", "b"), ("c2", "nobody")], "community_id string, entity_id string")
    facts = com.community_facts(t, m)
    assert facts.filter("community_id = 'c2'").count() == 0 and facts.filter("community_id = 'c1'").count() == 5
    got = {r["community_id"]: r["summary"] for r in com.summarise(facts, m, lambda p, s: p.split("\n")[0]).collect()}
    assert got == {"c1": "Community c1, 2 entities: a, b", "c2": ""}
    assert {r["community_id"]: r["summary"] for r in com.summarise(facts, m, lambda p, s: 1 / 0).collect()}["c1"] is None


def test_retrieval(spark):
    t = make(spark, [("Graph Sampling", "USED_IN", "Walks", "source_facts", 0.5), ("Secret", "P", "graph things", "llm_hypotheses", 0.3), ("Walks", "CONTAINS_KEY", "k=v"), ("Other", "P", "about graphs")])
    e = spark.createDataFrame([("Graph Sampling", "c"), ("Walks", "c"), (None, "c")], "id string, kind string")
    assert retrieval.anchor_terms("What about the Graph?! of (walks)") == ["graph", "walks"]
    assert retrieval.ranking_terms("what? graph!") == ["what", "graph"]
    seen = []
    c = spark.createDataFrame([("c1", 2, 0, "graph theory"), ("c2", 9, 0, "cooking"), ("c3", 1, 1, None)], "community_id string, member_count int, level int, summary string")
    m = spark.createDataFrame([("c1", "Other"), ("c1", None)], "community_id string, entity_id string")
    al = spark.createDataFrame([("Graph Sampling", "Walks")], "canonical_id string, alias_id string")
    r = retrieval.Retriever(t, e, c, m, al, client=lambda p, s: seen.append(p) or "said")
    got = r.ask("Tell me of graph sampling and walks")
    assert got["answer"] == "said" and got["anchor_entities"] == ["Graph Sampling", "Other"] and "Secret" not in seen[-1] and "[conf=0.50]" in seen[-1]
    g = r.ask("graph", "global")
    assert g["communities_used"] == 2 and g["subgraph_size"] == 11 and seen[-1].index("c1") < seen[-1].index("c2")
    d = r.ask("graph", "drift")
    assert d["communities_used"] == 2 and "(Other)" in seen[-1] and "Secret" not in seen[-1]
    assert r.ask("zzzz")["answer"] == retrieval.NOTHING and retrieval.Retriever(t, e).ask("graph", "global")["communities_used"] == 0
    broken = retrieval.Retriever(t, e, client=lambda p, s: 1 / 0).ask("graph")
    assert broken["answer"].startswith("LLM call failed")
    with pytest.raises(ValueError):
        r.ask("x", "sideways")
    assert [x["fact"] for x in retrieval.serialise(t).orderBy("place").collect()][-1] == "(Secret)-[P]->(graph things) [conf=0.30]"


def test_rate_window(spark):
    from datetime import datetime, timedelta

    rng = random.Random(9)
    rows = [(i, rng.choice("aab"), datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(600))) for i in range(200)]
    got = {r["event_id"]: r["in_window"] for r in rate_window(spark.createDataFrame(rows, "event_id int, user_id string, ts timestamp_ntz"), "user_id", "ts").collect()}
    assert got == {i: sum(1 for _, v, y in rows if v == u and timedelta(0) <= x - y <= timedelta(seconds=60)) for i, u, x in rows}


def test_streaming_ingest(spark, tmp_path):
    src = tmp_path / "in"
    one = spark.createDataFrame([("d1", "# Head\n[[Link]]", "a.md")], "doc_id string, text string, relative_path string")
    one.write.parquet(str(src))
    s = store.TripleStore(spark, str(tmp_path / "g"))
    for _ in range(2):
        q = ingest_stream(spark.readStream.schema(one.schema).parquet(str(src)), s, str(tmp_path / "cp"), "2024-01-01T00:00:00Z")
        q.awaitTermination()
    assert s.stats()["triples"] == 3
    one.write.mode("append").parquet(str(src))  # the same text again
    ingest_stream(spark.readStream.schema(one.schema).parquet(str(src)), s, str(tmp_path / "cp"), "2024-01-01T00:00:00Z").awaitTermination()
    assert s.stats()["triples"] == 3
