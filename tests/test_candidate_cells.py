"""Cells of a block are tasks of their own, however few bytes they have."""

from pyspark.sql import functions as F

from tripleloom.operators import resolve


def test_cells_are_spread_over_tasks(spark):
    ids = [f"abname{i}" for i in range(60)]
    blocked = spark.createDataFrame([(k, x, x, "p:ab") for k in ("person", None) for x in ids], "kind string, id string, norm string, block string")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = resolve.candidate_pairs(blocked, cell=10).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    want = sorted((a, b) for a in ids for b in ids if a < b)
    assert all(sorted((r["a"], r["b"]) for r in rows if r["kind"] == k) == want for k in ("person", None))
    assert len({r["task"] for r in rows}) > 4
