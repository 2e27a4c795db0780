"""The distributed partition, which graphs of more than LOCAL_EDGES edges take, against the one in one task."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from tripleloom.operators import communities as com


def graph(n=120, groups=8):
    rng = random.Random(4)
    return {(f"v{i:03}", f"v{j:03}"): rng.choice([1.0, 2.0]) for i in range(n) for j in range(i + 1, n) if rng.random() < (0.3 if i % groups == j % groups else 0.03)}


def modularity(edges, place):
    degree, inside, total = defaultdict(float), 0.0, 2 * sum(edges.values())
    for (a, b), w in edges.items():
        degree[place[a]] += w
        degree[place[b]] += w
        inside += 2 * w * (place[a] == place[b])
    return inside / total - sum((d / total) ** 2 for d in degree.values())


def test_distributed_moves_settle(spark):
    edges = graph()
    rows = [("", a, b, w) for (a, b), w in edges.items()]
    one = spark.createDataFrame(rows, "scope string, a string, b string, weight double")
    both = one.union(one.select("scope", F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    place = {r["v"]: r["c"] for r in com._moves(both, 1.0, 1, 0).collect()}
    before = modularity(edges, place)
    for v in place:  # no move of one vertex to a neighbour's community is better
        near = {place[b if a == v else a] for a, b in edges if v in (a, b)}
        assert all(modularity(edges, place | {v: c}) <= before + 1e-9 for c in near)
    far = {r["v"]: r["c"] for r in com.partition(one, local_edges=0).collect()}
    near = {r["v"]: r["c"] for r in com.partition(one).collect()}
    assert modularity(edges, far) >= 0.95 * modularity(edges, near)


def test_the_place_of_the_work_does_not_change_the_result(spark):
    rng = random.Random(8)
    rows = [("", a, b, w) for (a, b), w in graph(80, 5).items()]
    rows += [("x", f"u{i}", f"u{j}", 1.0) for i in range(12) for j in range(i + 1, 12) if (i < 6) == (j < 6) or rng.random() < 0.1]
    edges = spark.createDataFrame(rows, "scope string, a string, b string, weight double")
    got = [{(r["scope"], r["v"]): r["c"] for r in com.partition(edges, local_edges=n).collect()} for n in (10, 40, 10**9)]
    assert got[0] == got[1] == got[2] and len(set(got[0].values())) > 2
