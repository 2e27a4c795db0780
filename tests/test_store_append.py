"""The store appends: an insert writes its own rows only, and arrival decides what is first."""

import os

from tripleloom.operators.store import TripleStore

T = "n long, subject string, predicate string, object string, source_kind string, target_kind string, confidence double, layer string"


def rows(spark, *given):
    return spark.createDataFrame([(n, s, p, o, sk, tk, 0.9, "source_facts") for n, s, p, o, sk, tk in given], T)


def files(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_second_insert_writes_only_its_rows(spark, tmp_path):
    s = TripleStore(spark, str(tmp_path / "g"))
    twenty = rows(spark, *[(i, f"s{i}", "P", "o", "k", "k") for i in range(20)])
    assert s.add(twenty) == (20, 0) and s.add(twenty) == (0, 20)
    before = files(tmp_path)
    stamp = {f: os.stat(f).st_mtime_ns for f in before}
    assert s.add(rows(spark, (1, "new", "P", "o", "k", "k"), (2, "s1", "P", "o", "k", "k"))) == (1, 1)
    fresh = files(tmp_path) - before
    assert {f: os.stat(f).st_mtime_ns for f in before} == stamp
    assert spark.read.parquet(*[f for f in fresh if "/triples/" in f]).count() == 1 and s.count() == 21
    assert s.entities().count() == 22
    s.compact()
    assert s.count() == 21 and len(s.batches()) == 1 and s.entities().count() == 22


def test_first_arrival_decides(spark, tmp_path):
    s = TripleStore(spark, str(tmp_path / "g"))
    s.add(rows(spark, (3, "x", "P", "b", "late", "k"), (1, "x", "P", "a", "early", "k"), (2, "y", "P", "x", "k", "middle")), "n")
    assert {r["id"]: r["kind"] for r in s.entities().collect()}["x"] == "early"
    s.add(rows(spark, (0, "x", "P", "c", "later still", "k")), "n")
    assert {r["id"]: r["kind"] for r in s.entities().collect()}["x"] == "early"
    assert {(r["id"], r["kind"], r["other"]) for r in s.kind_conflicts().collect()} == {("x", "early", "middle"), ("x", "early", "late"), ("x", "early", "later still")}
    one = s.triples().first()
    assert s.by_id(one["triple_id"]).count() == 1


def test_a_batch_without_manifest_is_not_read(spark, tmp_path):
    s = TripleStore(spark, str(tmp_path / "g"))
    s.add(rows(spark, (1, "x", "P", "a", "k", "k")))
    s.triples(arrival=True).write.partitionBy("layer").parquet(f"{s.path}/triples/batch=2")  # a writer that died
    assert s.count() == 1
    s.add(rows(spark, (1, "z", "P", "a", "k", "k")))
    assert s.count() == 2 and s.batches() == [1, 3]
    assert s.purge("source_facts") == 2 and s.count() == 0 and s.entities().count() == 0
    assert s.add(rows(spark)) == (0, 0)
