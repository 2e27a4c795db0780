"""Whole bundles under dependencies over the triples, against every choice; groups of names."""

import random
from itertools import product

from tests.llm.test_llm_operators import T
from tripleloom.llm import copies, names

COLUMNS = f"{T}, source_doc string, adapter string, object_is_literal boolean"
LAYER = {"source_facts": 1, "inferred_relations": 3}


def has(x):
    return x is not None and x.strip().lower() not in ("", "n/a", "unknown", "none", "-")


def best(group):
    """By trying all choices: places given up, then the earlier bundles first."""
    rows = sorted(group, key=lambda r: (LAYER.get(r["layer"], 99), 99, -r["confidence"] if r["confidence"] is not None else 9e9, r["row_id"]))

    def distinct(ok, *cols):
        seen = {}
        for r in rows:
            if has(r[ok]):
                seen.setdefault(tuple(r[c] for c in cols), r)
        return list(seen.values())

    lists = [distinct("source", "source", "source_doc"), distinct("evidence", "evidence"), distinct("extraction_method", "adapter"), distinct("object_datatype")]
    docs, makers = {(r["source_doc"], r["evidence"]) for r in rows}, {(r["source"], r["adapter"]) for r in rows}

    def meets(o, q, p):
        return (o is None or q is None or (o["source_doc"], q["evidence"]) in docs) and (o is None or p is None or (o["source"], p["adapter"]) in makers)

    options = [list(enumerate(x)) or [(0, None)] for x in lists]
    ok = [c for c in product(*options) if meets(*(r for _, r in c[:3]))]
    choice = min(ok, key=lambda c: (sum(i for i, _ in c), [i for i, _ in c])) if ok else [x[0] for x in options]
    return {n: r["row_id"] for n, (_, r) in zip(copies.BUNDLES, choice, strict=True) if r is not None}


def test_bundles_against_all_choices(spark):
    rng = random.Random(11)
    names_ = [c.split()[0] for c in COLUMNS.split(", ")]
    rows = []
    for i in range(1, 260):
        r = dict.fromkeys(names_)
        r |= {"row_id": i, "subject": f"s{rng.randrange(45)}", "predicate": "P", "object": "o", "layer": rng.choice([*LAYER, "odd", None]), "confidence": rng.choice([None, 0.2, 0.9])}
        r |= {"extraction_method": rng.choice(["odd", "none", None]), "source": rng.choice(["a", "b", "c", " ", None]), "source_doc": rng.choice(["d1", "d2", "d3", None]), "evidence": rng.choice(["e1", "e2", "n/a", None]), "adapter": rng.choice(["x", "y", None]), "object_datatype": rng.choice(["t", "-", None])}
        rows.append(r)
    got = {}
    for r in copies.consistent_survivors(spark.createDataFrame([tuple(r[n] for n in names_) for r in rows], COLUMNS)).collect():
        got.setdefault(r["first_row_id"], {})[r["bundle"]] = r["row_id"]
    by = {}
    for r in rows:
        by.setdefault(r["subject"], []).append(r)
    want = {g[0]["row_id"]: best(g) for g in by.values() if len(g) > 1}
    assert got == {k: v for k, v in want.items() if v}


def test_bundles_of_nothing_and_of_nulls(spark):
    assert copies.consistent_survivors(spark.createDataFrame([], COLUMNS)).collect() == []
    nulls = spark.createDataFrame([(i, *[None] * 15) for i in (4, 2)], COLUMNS)
    assert copies.consistent_survivors(nulls).collect() == []


def test_groups_of_names(spark):
    df = spark.createDataFrame([(x, "person") for x in ("Olga Zekkanuri", "OLGA ZEKKANURI", "olga_zekkanuri", "Henry Hofbatelin")] + [(None, None), ("doc:1", "document")], "id string, kind string")
    forms = spark.createDataFrame([("Bob", "Robert")], "short_form string, full_form string")
    got = {r["id"]: r["group_id"] for r in names.name_groups(df, forms).collect()}
    assert got == {"Olga Zekkanuri": "OLGA ZEKKANURI", "OLGA ZEKKANURI": "OLGA ZEKKANURI", "olga_zekkanuri": "OLGA ZEKKANURI", "Henry Hofbatelin": "Henry Hofbatelin"}
