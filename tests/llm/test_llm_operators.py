import math
import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tripleloom.llm import copies, groups, mixing, names, packing, sizes, spans

# --- groups ------------------------------------------------------------------------------------


def brute_groups(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("cell", [3, 1000])
def test_groups_against_union_find(spark, cell):
    rng = random.Random(2)
    ids = [f"{c}{i}" for c in "aZé" for i in range(40)] + ["", "\U0001f600"]
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(70)] + [("a0", rng.choice(ids)) for _ in range(10)] + [(f"p{i}", f"p{i + 1}") for i in range(25)] + [(None, "x"), ("y", None), (None, None), ("me", "me"), ("a1", "a1")]
    df = spark.createDataFrame([(*p, 1, 2) for p in pairs], "canonical_id string, alias_id string, u int, root int")
    got = {r["entity_id"]: r["group_id"] for r in groups.match_groups(df, "canonical_id", "alias_id", cell).collect()}
    assert got == brute_groups(pairs)


def test_groups_of_nothing(spark):
    df = spark.createDataFrame([], "canonical_id string, alias_id string")
    assert groups.match_groups(df, "canonical_id", "alias_id").collect() == []


# --- copies and best record --------------------------------------------------------------------

T = "row_id long, subject string, predicate string, object string, layer string, extraction_method string, confidence double, timestamp string, evidence string, source string, object_datatype string, h string, first string"


def ld(x):
    return None if x is None else "".join(c for c in unicodedata.normalize("NFC", x).lower() if unicodedata.category(c)[0] in "LN")


def brute_key(s, p, o):
    p2 = ld(p)
    o2 = o if o is None else ("|" + "|".join(sorted(x for x in map(ld, o.split("|")) if x)) if "|" in o else ld(o))
    s2 = ld(s)
    if p2 in ("similarto", "sameas"):
        s2, o2 = sorted((s2 or "\x00", o2 or "\x00"))
    return s2, p2, o2


def make(rng, n):
    rows = []
    for i in range(1, n):
        s, p, o = rng.choice([("A b", "LINKS_TO", "c"), ("a-B", " links to", "C."), ("x", "SIMILAR_TO", "y"), ("Y", "SimilarTo", "X"), ("k", "CONTAINS_KEY", "a=1 | b=2"), ("k", "contains-key", "B=2|A=1|"), ("é", "P", "é"), (None, "P", None), ("", "P", ""), ("hot", "P", "hot"), ("hot", "P", "HOT"), ("s", "HAS_STATUS", "v")])
        rows.append((i, s, p, o, rng.choice([" Source_Facts", "llm_hypotheses", None, "odd"]), rng.choice(["LLM", "rule ", None]), rng.choice([None, 0.5, 0.9, float("nan")]), rng.choice(["2024-01-01", "2024-01-02T00:00:00Z", "?", None]), rng.choice([None, " ", "N/A", "text"]), rng.choice(["-", "src", None]), rng.choice([None, "xsd:string", "Unknown"]), "q", "z"))
    return rows


def test_copies_and_survivors_against_brute_force(spark):
    rows = make(random.Random(4), 160)
    df = spark.createDataFrame(rows, T)
    by = defaultdict(list)
    for r in rows:
        if r[2] != "HAS_STATUS":
            by[brute_key(r[1], r[2], r[3])].append(r)
    want = {(min(x[0] for x in g), r[0]) for g in by.values() for r in g if r[0] != min(x[0] for x in g)}
    assert {tuple(r) for r in copies.fact_copies(df).collect()} == want
    assert {tuple(r) for r in copies.collapse(df).collect()} == {(min(x[0] for x in g), len(g)) for g in by.values()}
    layers, methods, stamps = {" Source_Facts": 1, "llm_hypotheses": 4}, {"LLM": 3, "rule ": 2}, {"2024-01-01": 1, "2024-01-02T00:00:00Z": 2}

    def rank(r):
        c = None if r[6] is None or math.isnan(r[6]) else r[6]
        return layers.get(r[4], 99), methods.get(r[5], 99), -c if c is not None else math.inf, -stamps.get(r[7], -1), r[0]

    best = set()
    for g in by.values():
        if len(g) > 1:
            g = sorted(g, key=rank)
            f = min(x[0] for x in g)
            best.add((f, "record", g[0][0]))
            for name, i in (("evidence", 8), ("source", 9), ("object_datatype", 10)):
                have = [r for r in g if (r[i] or "").strip().lower() not in ("", "n/a", "unknown", "none", "-")]
                if have:
                    best.add((f, name, have[0][0]))
    assert {tuple(r) for r in copies.survivors(df).collect()} == best


def test_copies_of_nothing_and_very_long(spark):
    assert copies.fact_copies(spark.createDataFrame([], T)).collect() == []
    assert copies.survivors(spark.createDataFrame([], T)).collect() == []
    long = "x" * 200_000
    rows = [(i, long, "P", long, *[None] * 9) for i in (5, 3, 9)]
    assert sorted(tuple(r) for r in copies.fact_copies(spark.createDataFrame(rows, T)).collect()) == [(3, 5), (3, 9)]


def test_bundles_meet_dependencies(spark):
    """city and zip are bundles of their own; the chosen zip must occur with the chosen city."""
    rows = [(1, 10, 1, "Bonn", None), (1, 11, 2, None, "99"), (1, 12, 3, "Bonn", "53"), (1, 13, 4, "Ulm", "99"), (2, 20, 1, "Ulm", "89"), (3, 30, 1, "A", None), (3, 31, 2, None, "B")]
    df = spark.createDataFrame(rows, "g long, row long, r int, city string, zip string")
    rank = F.struct("r", F.col("row").alias("row"))
    give = {"c": F.col("city").isNotNull(), "z": F.col("zip").isNotNull()}
    for k in (1, 8):
        got = {(r["g"], r["bundle"]): r["row"] for r in copies.best_bundles(df, "g", rank, give, [("c.city", "z.zip")], first_k=k).collect()}
        assert got[(1, "c")] == 10 and got[(1, "z")] == 12  # rank 1 + 3 beats 4 + 2
        assert got[(2, "c")] == got[(2, "z")] == 20
        assert got[(3, "c")] == 30 and got[(3, "z")] == 31  # no choice meets it: the best of each stands
    free = {(r["g"], r["bundle"]): r["row"] for r in copies.best_bundles(df, "g", rank, give).collect()}
    assert free[(1, "z")] == 11


# --- packing -----------------------------------------------------------------------------------


def unfold(rows):
    bins = defaultdict(list)
    for size, _, n, first, each in rows:
        for i in range(n):
            bins[first + i // each].append(size)
    return bins


def naive(sizes_, capacity):
    """Item by item: large-item matching, then best fit in order of size."""
    large, bins = sorted(s for s in sizes_ if 3 * s > capacity), []
    while large:
        a = large.pop()
        b = [x for x in large if x <= capacity - a]
        if b:
            large.remove(b[-1])
            bins.append([a, b[-1]])
        else:
            bins.append([a])
    for s in sorted((s for s in sizes_ if 3 * s <= capacity), reverse=True):
        fit = [(capacity - sum(b), i) for i, b in enumerate(bins) if sum(b) + s <= capacity]
        if fit:
            bins[min(fit)[1]].append(s)
        else:
            bins.append([s])
    return bins


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 60).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=80))))
def test_plan_is_the_item_by_item_greedy(case):
    capacity, items = case
    bins = unfold(packing.plan(dict(Counter(items)), capacity))
    assert Counter(x for b in bins.values() for x in b) == Counter(items)
    assert sorted(bins) == list(range(len(bins)))
    assert all(sum(b) <= capacity and sum(3 * x > capacity for x in b) <= 2 for b in bins.values())
    assert Counter(sum(b) for b in bins.values()) == Counter(map(sum, naive(items, capacity)))


def test_pack_places_every_token_once(spark):
    rng = random.Random(1)
    items = [(i, rng.choice([0, 1, 7, 7, 7, 30, 64, 65, 200])) for i in range(300)]
    got = packing.pack(spark.createDataFrame(items, "id long, n_tokens int"), 64, "t").collect()
    room, parts = Counter(), defaultdict(list)
    for r in got:
        room[r["bin"]] += r["size"]
        parts[r["id"]].append((r["piece"], r["offset"], r["size"]))
    assert max(room.values()) <= 64
    for i, n in items:
        p = sorted(parts.get(i, []))
        assert sum(x[2] for x in p) == n and [x[1] for x in p] == [64 * k for k in range(len(p))]
        assert len(p) == -(-n // 64)
    assert packing.pack(spark.createDataFrame([], "id long, n_tokens int"), 64, "e").collect() == []


def test_fill_containers_edge_cases(spark):
    docs = spark.createDataFrame([(1, "word " * 30000, "x"), (2, None, "x"), (3, "", "x"), (None, "text", "x"), (4, "a", "x")], "doc_id long, text string, bin string")
    boxes = spark.createDataFrame([("s", 512), ("none", 0), (None, 100), ("s", 512)], "container string, capacity_tokens int")
    got = packing.fill_containers(docs, boxes).collect()
    assert {r["container"] for r in got} == {"s", None} and {r["doc_id"] for r in got} == {1, 4}
    report = {r["container"]: r for r in packing.fill_report(spark.createDataFrame(got), boxes).collect()}
    assert report["s"]["bins"] - report["s"]["least_bins"] <= 1
    assert packing.fill_containers(docs, boxes.limit(0)).collect() == []


@settings(max_examples=30, deadline=None)
@given(st.text(alphabet="ab 1.\n'é", max_size=400))
def test_pieces_do_not_change_the_count(text):
    text = text * 40
    old, sizes.PIECE = sizes.PIECE, 97
    try:
        assert "".join(sizes._pieces(text)) == text
        assert sizes.count_tokens(text, sizes.DEFAULT_VOCABULARY) == len(sizes.encoding(sizes.DEFAULT_VOCABULARY).encode_ordinary(text))
    finally:
        sizes.PIECE = old


# --- mixing ------------------------------------------------------------------------------------


def poisson(u, rate, most):
    n, term, below = 0, math.exp(-rate), 0.0
    for k in range(most):
        below += term
        n += below <= 1 - u
        term *= rate / (k + 1)
    return n


def test_thresholds_are_where_copies_appear(spark):
    u = np.random.default_rng(0).random(50)
    t = mixing.thresholds(u, 4)
    for i, x in enumerate(u):
        for k in range(4):
            assert poisson(x, t[i, k] * 1.0001, 4) >= k + 1 > poisson(x, t[i, k] * 0.9999, 4)
    df = spark.createDataFrame([(float(x), 1.3) for x in u], "u double, r double")
    assert [r[0] for r in df.select(mixing.copies(F.col("u"), F.col("r"), 4)).collect()] == [poisson(x, 1.3, 4) for x in u]
    v = np.random.default_rng(1).random(200_000)
    draws = np.sum(np.cumsum(np.exp(-2.0) * np.array([1, 2, 2, 4 / 3, 2 / 3, 4 / 15]))[None, :] <= (1 - v)[:, None], axis=1)
    assert abs(draws.mean() - 2.0) < 0.05


def test_mixture_meets_its_targets(spark):
    rng = random.Random(6)
    docs = [(i, " ".join(["word"] * rng.randrange(1, 60)), rng.choice(["a", "A-b", "a_b", "a b ", "c", "c", "c", None, "other"]), i) for i in range(3000)] + [(None, "x", "a", 0), (9999, None, "a", 0), (10000, "", "c", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, rate int")
    mix = spark.createDataFrame([("a", 0.5, 3), ("a_b", 0.2, 1), ("C", 0.25, 2), ("gone", 0.05, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    shares = {r["source"]: r for r in mixing.mixture_shares(df, mix).collect()}
    assert shares["gone"]["tokens"] == 0 and abs(sum(r["actual_share"] for r in shares.values()) - 1) < 1e-9
    for s in ("a", "a_b", "c"):
        assert abs(shares[s]["actual_share"] - shares[s]["reachable_share"]) < 0.005
    rows = mixing.mixture(df, mix).collect()
    assert [r["place"] for r in rows] == sorted(r["place"] for r in rows)
    times = Counter(r["doc_id"] for r in rows)
    kinds = {r["doc_id"]: r["source"] for r in rows}
    cap = {"a": 3, "a_b": 1, "c": 2}
    assert all(n <= cap[kinds[d]] for d, n in times.items())
    tokens = Counter()
    for r in rows:
        tokens[r["source"]] += sizes.count_tokens(r["text"], sizes.DEFAULT_VOCABULARY)
    assert {s: shares[s]["tokens"] for s in cap} == dict(tokens)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert Counter((r["doc_id"], r["copy_no"]) for r in mixing.mixture(df, mix).collect()) == Counter((r["doc_id"], r["copy_no"]) for r in rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_mixture_of_nothing_and_a_budget(spark):
    mix = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mixture(none, mix).collect() == []
    assert [r["tokens"] for r in mixing.mixture_shares(none, mix).collect()] == [0]
    docs = spark.createDataFrame([(i, "one two three", "a") for i in range(500)], "doc_id long, text string, source string")
    assert abs(mixing.mixture_shares(docs, mix, budget=600).first()["tokens"] - 600) <= 3


# --- spans -------------------------------------------------------------------------------------


def brute_spans(docs, run):
    seen = defaultdict(set)
    for d, t in docs:
        for i in range(len(t or "") - run + 1):
            seen[t[i : i + run]].add(d)
    out = {}
    for d, t in docs:
        hit = set()
        for i in range(len(t or "") - run + 1):
            if len(seen[t[i : i + run]]) > 1:
                hit |= set(range(i, i + run))
        if hit:
            out[d] = len(hit)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_spans_against_brute_force(spark, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(spans, "CHUNK", 700)
    pool = ["".join(rng.choice("ab ä\U0001f600") for _ in range(rng.randrange(20, 120))) for _ in range(12)] + ["x" * 90, "xy" * 50]
    docs = [(i, "".join(rng.choice([rng.choice(pool), rng.choice(pool)[: rng.randrange(40)], "".join(rng.choice("abcdefgh") for _ in range(15))]) for _ in range(rng.randrange(0, 14)))) for i in range(40)]
    docs += [(100, None), (101, ""), (102, docs[0][1]), (103, docs[0][1]), (104, "q" * 5000), (105, "q" * 4000)]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in docs] + [(None, docs[0][1], 1, 2)], "doc_id long, text string, h int, doc int")
    got = {r["doc_id"]: r["shared_chars"] for r in spans.shared_chars(df, run=30, phrase=15).collect()}
    assert got == brute_spans(docs, 30)


def test_spans_of_nothing(spark):
    assert spans.shared_chars(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    lone = spark.createDataFrame([(1, "abc" * 100 + "z" + "abc" * 100)], "doc_id long, text string")
    assert spans.shared_chars(lone).collect() == []  # what stands twice in one document is not shared


# --- names -------------------------------------------------------------------------------------


def osa(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=400, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_one_letter_apart(a, b):
    assert names.osa_one(a, b) == (osa(a, b) <= 1)
    if osa(a, b) <= 1:
        assert names.deletions(a) & names.deletions(b)


def test_words():
    assert names.words("Dr. José BobsonLeeIndex") == ["jose", "bobson", "lee", "index"]
    assert names.words("N.B.A.F.M.") == ["nbafm"]
    assert names.words("Nested Bound Fact (NBF)") == ["nested", "bound", "fact"]
    assert names.words("Semantic Store (Lidal)") == ["semantic", "store", "lidal"]
    assert names.words("Kolvan RS") == ["kolvan", "r", "s"]
    assert names.words("") == [] and names.words("...") == []


def test_names_end_to_end(spark):
    given_, first = ["Robert", "Olga", "Henry", "Wanda"], ["Gonbaldu", "Tirukepan", "Malsurenko", "Pilvadoro", "Zekkanuri", "Hofbatelin"]
    ents = [f"{g} {f}" for g in given_ for f in first] + [f"{f} Graph Store" for f in first]
    same = [("Robert Gonbaldu", x) for x in ("ROBERT GONBALDU", "Gonbaldu, Bob", "Robert Gonbadlu", "Dr Robert K. Gonbaldu", "robert_gonbaldu", "Róbert Gonbaldu")] + [("Pilvadoro Graph Store", x) for x in ("Graph Store (Pilvadoro)", "PilvadoroGraphStore", "The Pilvadoro-Graph Stores")]
    # a bridge: one letter from either end, the ends two letters apart
    same += [("Olga Zekkanuri", "Olga Zekanuri"), ("Olga Zekkanuri", "Olga Zekanur")]
    alone = ["Pilvadoro Graph Store v2", "doc:abc", "rec:abc", "atag", "   ", "..."]
    rows = [(x, "person") for x in ents] + [(b, None) for _, b in same] + [(x, "tag" if x == "atag" else "concept") for x in alone] + [("Olga Zekanuri", "person"), (None, "person")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id string, kind string, cluster int")
    forms = spark.createDataFrame([("Bob", "Robert", "nickname"), (None, "x", "y"), ("z", None, "n")], "short_form string, full_form string, form_kind string")
    labels = spark.createDataFrame([("Robert Gonbaldu", "Gonbaldu, Bob", True), (None, None, None)], "id_a string, id_b string, same boolean")
    got = {(r["id_a"], r["id_b"]) for r in names.same_names(df, forms, labels).collect()}
    root = brute_groups(same)
    want = {(a, b) for a in root for b in root if a < b and root[a] == root[b]}
    assert got == want
    assert names.same_names(df.limit(0), forms, labels).collect() == []
