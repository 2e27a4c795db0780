"""Pairs that merge: met in grids, kept only where they join groups, joined in one task or in rounds."""

import random

import numpy as np

from tripleloom.functions.naming import NameGrid, jaro_winkler_value
from tripleloom.operators import graph, resolve


def test_name_grids_agree_with_the_textbook_function(monkeypatch):
    rng = random.Random(1)
    for letters, longest, head in (("ab", 8, ""), ("0123456789abcdef", 16, "doc"), ("abcdefghij", 34, ""), ("abcdefgh", 70, "x"), ("aé😀b", 9, "")):
        names = [head + "".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(90)]
        names += [x[:-1] + rng.choice(letters) for x in names[:30] if x] + names[:3]
        rows = [*names[:40], "doc", "", head]
        starts = np.sort(np.array([0] * 20 + [rng.randint(0, len(names)) for _ in rows[20:]]))
        for floor in (0.5, 0.7, 0.85, 1.0):
            want = {(i, j, v) for i, a in enumerate(rows) for j, b in enumerate(names) if j >= starts[i] and (v := jaro_winkler_value(a, b)) >= floor}
            for bound, match, row in ((50, 7, 0), (1 << 17, 1 << 14, 6000)):
                for key, n in (("BOUND", bound), ("MATCH", match), ("ROW", row)):
                    monkeypatch.setattr(NameGrid, key, n)
                got = [(int(a), int(b), float(v)) for x in NameGrid(rows, names).near(starts, floor) for a, b, v in zip(*x, strict=True)]
                assert len(got) == len(want) and set(got) == want


def _groups(links):
    of = {}
    for a, b in links:
        x, y = of.setdefault(a, {a}), of.setdefault(b, {b})
        if x is not y:
            x |= y
            of.update(dict.fromkeys(y, x))
    return {frozenset(x) for x in of.values()}


def _best(links):
    out = {}
    for a, b, score in links:
        for i in (a, b):
            out[i] = max(out.get(i, 0), score)
    return out


def _blocked(spark):
    rng = random.Random(4)
    ids = [f"doc:{x:06x}" for x in rng.sample(range(1 << 24), 400)] + ["doc:x", "Document On Columns X", "Docx"]
    names = ["".join(rng.choice("bdklmnst") + rng.choice("aeiou") for _ in range(4)).title() for _ in range(300)]
    rows = [(x, "document") for x in ids] + [(x, "person") for x in names]
    return resolve.blocks(resolve.classes(spark.createDataFrame(rows, "id string, kind string"))).cache()


def test_links_join_the_groups_of_all_pairs_by_the_best_of_each_member(spark, monkeypatch):
    b = _blocked(spark)
    score = lambda r: resolve.SHORT_SCORE if r["short"] else r["jw"]
    every = {(r["a"], r["b"], score(r)) for r in resolve.near_pairs(b, 0.85).collect()}
    assert any(s == resolve.SHORT_SCORE for _, _, s in every)
    for cell, rows in ((None, 4000), (150, 40)):
        monkeypatch.setattr(resolve, "LINK_ROWS", rows)
        got = [(r["a"], r["b"], score(r)) for r in resolve.near_pairs(b, 0.85, cell, links=True).collect()]
        assert set(got) <= every and _best(got) == _best(every)
        assert _groups([x[:2] for x in got]) == _groups([x[:2] for x in every])
        if cell is None:  # a block in one task: fewer links than members, where all pairs were kept before
            assert sum(a.startswith("doc:") and b.startswith("doc:") for a, b, _ in got) < 401 < len(every)


def test_merging_writes_links_instead_of_all_pairs(spark, monkeypatch):
    written = {}

    def materialise(df, label="step", of=resolve.materialise):
        written[label] = of(df, label)
        return written[label]

    monkeypatch.setattr(resolve, "materialise", materialise)
    rng = random.Random(8)
    ids = [f"doc:{rng.getrandbits(40):010x}" for _ in range(600)]
    resolve.resolve(spark.createDataFrame([(x, "document") for x in ids], "id string, kind string"), spark.createDataFrame([], "subject string, predicate string, object string"))
    assert written["auto"].count() < 2 * len(ids)  # thousands before


def test_components_are_the_same_in_one_task_and_in_rounds(spark, monkeypatch):
    rng = random.Random(9)
    links = [(f"n{rng.randint(0, 300)}", f"n{rng.randint(0, 300)}") for _ in range(200)] + [(f"m{i}", f"m{i + 1}") for i in range(60)] + [("q", "q")]
    df = spark.createDataFrame(links, "a string, b string")
    want = {x: min(g, key=lambda n: (len(n), n)) for g in _groups(links) for x in g}
    for most in (10**6, 40, -1):
        monkeypatch.setattr(graph, "LOCAL_LINKS", most)
        assert {r["id"]: r["root"] for r in graph.components(df, "a", "b", graph.shortest_first).collect()} == want


def test_aliases_have_their_best_pair_of_all_though_few_are_written(spark, monkeypatch):
    written = {}

    def materialise(df, label="step", of=resolve.materialise):
        written[label] = of(df, label)
        return written[label]

    monkeypatch.setattr(resolve, "materialise", materialise)
    monkeypatch.setattr(resolve, "LINK_ROWS", 150)
    entities, triples = _blocked(spark).select("id", "kind").distinct(), spark.createDataFrame([], "subject string, predicate string, object string")
    every = [(r["a"], r["b"], r["score"], r["method"]) for r in resolve.matches(entities).filter("band = 'auto'").collect()]
    best = {}
    for a, b, score, method in every:
        for i in (a, b):
            best[i] = min(best.get(i, (0, "")), (-score, method))
    canonical = {x: min(g, key=lambda n: (len(n), n)) for g in _groups([x[:2] for x in every]) for x in g}
    got = [tuple(r) for r in resolve.resolve(entities, triples)["aliases"].collect()]
    want = {(c, x, -best[x][0], 2, best[x][1]) for x, c in canonical.items() if x != c}
    assert len(got) == len(want) and set(got) == want and {x[4] for x in got} == {"jaro_winkler", "initialism"}
    assert written["links"].count() < len(every) * 2 / 3  # all of them before
