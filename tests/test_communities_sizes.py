"""Communities of every size and the large ones of one detection."""

from tripleloom.operators import communities as com


def test_large_communities_are_those_of_one_detection(spark):
    rows = [(0, "a", "L0:a", x) for x in "abc"]
    levels = spark.createDataFrame([(level, None, c, x) for level, _, c, x in [*rows, (0, "", "L0:d", "d"), (0, "", "L0:d", "e")]], "level int, parent string, community string, entity string")
    assert {r["entity"] for r in com.large_enough(levels).collect()} == {"a", "b", "c"}
    assert com.large_enough(levels, 1).count() == 5
