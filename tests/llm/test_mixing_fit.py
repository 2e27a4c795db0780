"""Long documents in a small source: the target is met by copies that fit."""

from tripleloom.llm import mixing


def test_shares_hold_where_documents_are_long(spark):
    docs = [(i, " ".join(["word"] * (900 if i % 7 == 0 else 5 + i % 40)), "ab"[i % 2]) for i in range(300)] + [(i, "word " * 60, "c") for i in range(300, 312)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    mix = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4)], "source string, target_share double, max_repeats int")
    for r in mixing.mixture_shares(df, mix).collect():
        assert abs(r["actual_share"] - r["reachable_share"]) < 0.005 and r["max_copies"] <= {"a": 1, "b": 2, "c": 4}[r["source"]]


def test_repeated_ids_and_nulls_are_fitted_alike(spark):
    docs = [(i // 2, "word " * (20 + i), "a") for i in range(60)] + [(None, "word", "a"), (99, None, "a")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    mix = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    rows = mixing.mixture(df, mix, budget=1500).collect()
    by = {}
    for r in rows:
        by.setdefault((r["doc_id"], r["text"]), set()).add(r["copy_no"])
    times = {}
    for (d, _), c in by.items():
        times.setdefault(d, set()).add(len(c))
    assert all(len(n) == 1 and max(n) <= 2 for n in times.values())
