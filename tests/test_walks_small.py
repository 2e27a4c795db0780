"""Small graphs get several walks a node."""

import pytest

from tripleloom.operators import vectors


@pytest.mark.parametrize(("nodes", "each"), [(2, 50), (10, 20), (150, 1)])
def test_walks_are_dealt_out(spark, nodes, each):
    e = [(f"n{i}", f"n{(i + 1) % nodes}") for i in range(nodes)]
    adj = spark.createDataFrame(sorted({x for a, b in e for x in ((a, b), (b, a))}), "src string, dst string")
    assert sum(r["n"] for r in vectors.walk_pairs(adj).collect()) == nodes * each * 5
