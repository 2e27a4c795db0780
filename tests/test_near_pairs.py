"""Pairs compared where they meet, against the textbook function pair by pair."""

import random

from pyspark.sql import functions as F

from tripleloom.functions.naming import NameColumns, initialism, jaro_winkler_value
from tripleloom.operators import resolve


def test_name_columns_agree_with_the_textbook_function():
    rng = random.Random(3)
    for letters, longest in (("ab", 8), ("0123456789abcdef", 20), ("abcdefghij", 34), ("abcdefgh", 70)):
        names = ["".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(80)]
        names += [x[:-1] + rng.choice(letters) for x in names[:30] if x] + names[:3]
        columns = NameColumns(names)
        for floor in (0.5, 0.7, 0.85, 1.0):
            for a in names[:20]:
                want = {i: v for i, b in enumerate(names) if i >= 5 and (v := jaro_winkler_value(a, b)) >= floor}
                assert {int(i): v for at, vs in columns.near(a, floor, 5) for i, v in zip(at, vs, strict=True)} == want


def _blocked(spark):
    rng = random.Random(4)
    ids = [f"doc:{rng.getrandbits(64):016x}" for _ in range(300)] + ["doc:x", "Document On Columns X", "Docx", "Dökumentation", "Knotan Bo", "Notan Bo"]
    kinds = [(x, "document") for x in ids] + [(x, None) for x in ids[:40]]
    return resolve.blocks(resolve.classes(spark.createDataFrame(kinds, "id string, kind string")))


def test_near_pairs_are_the_candidates_that_reach_the_floor_in_any_cells(spark):
    b = _blocked(spark).cache()
    every = resolve.candidate_pairs(b).withColumn("short", initialism(F.col("a"), F.col("b"))).collect()
    for floor in (0.7, 0.85):
        want = {(r["kind"], r["a"], r["b"], v if v >= floor else 0.0, r["short"]) for r in every if (v := jaro_winkler_value(r["norm_a"], r["norm_b"])) >= floor or r["short"]}
        assert any(x[4] for x in want) and len(want) < len(every) / 4
        for cell in (8000, 90):
            got = [tuple(r) for r in resolve.near_pairs(b, floor, cell).collect()]
            assert len(got) == len(want) and set(got) == want


def _resolved(spark, monkeypatch):
    """The tables that resolving opaque ids writes, by label, and its result."""
    kept = {}

    def materialise(df, label="step", of=resolve.materialise):
        kept[label] = of(df, label)
        return kept[label]

    monkeypatch.setattr(resolve, "materialise", materialise)
    entities = _blocked(spark).select("id", "kind").filter("kind is not null").distinct()
    triples = spark.createDataFrame([("x", "P", "y")], "subject string, predicate string, object string")
    return kept, resolve.resolve(entities, triples)


def test_groups_are_made_without_writing_flagged_pairs(spark, monkeypatch):
    kept, r = _resolved(spark, monkeypatch)
    assert {x["canonical"] for x in r["canonical"].collect()}
    assert not [k for k, t in kept.items() if "band" in t.columns and t.filter("band <> 'auto'").head(1)]
    assert r["flagged"].filter("score >= 0.7 and score < 0.85").count() == r["flagged"].count() > 0


def test_aliases_have_the_best_score_of_all_pairs_that_merge(spark, monkeypatch):
    kept, r = _resolved(spark, monkeypatch)
    best = {}
    for x in kept["auto"].collect():  # before, pairs that only may merge were kept in its place
        for i in (x["a"], x["b"]):
            best[i] = max(best.get(i, 0), x["score"])
    got = {x["alias_id"]: x["confidence"] for x in r["aliases"].collect()}
    assert got and all(best[i] == c for i, c in got.items())


def test_what_all_names_begin_with_takes_no_bits():
    rng = random.Random(7)
    names = sorted(f"doc{rng.getrandbits(64):016x}" for _ in range(120))
    columns = NameColumns(names)
    assert all(b.itemsize == 2 for part in columns.parts for b in part[3].values())  # 19 characters had 32 bits
    for a in [*names[:20], "doc", "do", "rec" + names[0][3:], "d0" + names[1]]:
        want = {i: v for i, b in enumerate(names) if (v := jaro_winkler_value(a, b)) >= 0.7}
        assert {int(i): v for at, vs in columns.near(a, 0.7) for i, v in zip(at, vs, strict=True)} == want


def test_large_cells_are_shared_by_tasks_and_make_each_pair_once(spark, monkeypatch):
    b = _blocked(spark).cache()
    want = sorted(map(tuple, resolve.near_pairs(b, 0.7).collect()), key=str)
    for shares in (1, 3):
        monkeypatch.setattr(resolve, "CELL_SHARES", shares)
        assert sorted(map(tuple, resolve.near_pairs(b, 0.7, 90).collect()), key=str) == want
