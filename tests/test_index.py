"""The vector index against brute force."""

import numpy as np
import pytest

from tripleloom.operators import index
from tripleloom.operators.vectors import nearest


def data(spark, n, dim=12):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, dim)) + 3 * rng.normal(size=(7, dim))[rng.integers(0, 7, n)]
    rows = [(f"v{i}", [float(v) for v in x[i]]) for i in range(n)] + [("null", None), ("zero", [0.0] * dim)]
    return spark.createDataFrame(rows, "id string, vec array<float>")


def test_every_cell_is_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "DATA_CELL", 20)
    d = data(spark, 300)
    q = d.filter("id in ('v1', 'v7', 'zero', 'null')")
    index.build(d, cells=9).save(str(tmp_path / "i"))
    i = index.VectorIndex.load(spark, str(tmp_path / "i"))
    assert i.rows.count() == 301 and len(i.centroids) == 9
    want = {(r["query"], r["rank"]): (r["id"], round(r["score"], 6)) for r in nearest(d, q, 5).collect()}
    assert {(r["query"], r["rank"]): (r["id"], round(r["score"], 6)) for r in i.search(q, 5, 9).collect()} == want


def test_recall_reaches_its_target(spark):
    d = data(spark, 2000)
    i = index.build(d, sample=500)
    assert i.probes < len(i.centroids) and i.recall(d.filter("id like 'v%7'"), 10) >= 0.9


@pytest.mark.parametrize("n", [0, 1])
def test_hardly_any_rows(spark, n):
    d = data(spark, 3).filter("id = 'v0'").limit(n)
    i = index.build(d)
    assert i.search(data(spark, 3).filter("id = 'v1'")).count() == n


def test_sparse_cells_still_give_k_rows(spark):
    d = data(spark, 40)
    i = index.build(d, cells=20)
    assert i.search(d.filter("id = 'v3'"), 15, 1).count() == 15
