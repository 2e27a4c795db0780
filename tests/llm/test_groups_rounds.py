"""The grid's rounds grow with the logarithm of the vertices, whatever the shape and order of the links."""

import math
import random

import pytest

from tripleloom.llm import groups


def shape(spark, name, n):
    if name == "chain":
        return spark.range(n - 1).selectExpr("id u", "id + 1 v")
    if name == "star":
        return spark.range(1, n).selectExpr("0l u", "id v")
    if name == "tree":
        return spark.range(1, n).selectExpr("(id - 1) div 2 u", "id v")
    p = list(range(n))
    random.Random(3).shuffle(p)
    return spark.createDataFrame(list(zip(p, p[1:], strict=False)), "u long, v long")


@pytest.mark.parametrize(("name", "n", "cell"), [("chain", 100_000, 1000), ("random", 20_000, 200), ("star", 20_000, 200), ("tree", 20_000, 200)])
def test_rounds_are_logarithmic(spark, name, n, cell):
    log = []
    got = groups.grid_components(shape(spark, name, n), cell, log)
    assert got.count() == n and [r["root"] for r in got.select("root").distinct().collect()] == [0]
    assert 1 < len(log) <= 2 * math.log2(n)


def test_a_small_table_is_cut_into_a_grid_too(spark):
    log = []
    pairs = spark.createDataFrame([(f"k{i:03}", f"k{i + 2:03}") for i in range(300)], "a string, b string")
    edges = spark.range(300).selectExpr("id u", "id + 2 v")
    assert groups.grid_components(edges, log=log).select("root").distinct().count() == 2 and len(log) > 1
    got = {r["entity_id"]: r["group_id"] for r in groups.match_groups(pairs, "a", "b").collect()}
    assert got == {f"k{i:03}": f"k{i % 2:03}" for i in range(302)}


def test_cells_with_too_many_links_are_cut(spark):
    edges = spark.range(1, 4000).selectExpr("0l u", "id v").union(spark.range(1, 50).selectExpr("id u", "id + 5000 v"))
    got = groups.grid_components(edges, 50)
    assert got.count() == 4049 and got.filter("root <> 0").count() == 0
