"""Blocks, automata and comparisons of shared spans, each against brute force."""

import random

import numpy as np
import pytest

from tests.llm.test_llm_operators import brute_spans
from tripleloom.llm import spans


def corpus(seed, n=60):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(20, 90))) for _ in range(15)] + ["z" * 70]
    return [(i, "".join(rng.choice([rng.choice(pool), rng.choice(pool)[rng.randrange(30) :], "".join(rng.choice("fghij") for _ in range(9))]) for _ in range(rng.randrange(0, 12)))) for i in range(n)]


@pytest.mark.parametrize(("block", "together", "batch"), [(400, 10**6, 2), (10**6, 0, 10_000), (1, 2, 3), (900, 10**6, 10_000)])
def test_any_cut_gives_the_same_spans(spark, monkeypatch, block, together, batch):
    monkeypatch.setattr(spans, "BLOCK", block)
    monkeypatch.setattr(spans, "PAIRS", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        docs = corpus(block)
        found = spans.merged(spans.shared_spans(spark.createDataFrame(docs, "doc_id long, text string"), run=30, phrase=15, together=together))
        got = {}
        for r in found.collect():
            got[r["doc"]] = got.get(r["doc"], 0) + r["stop"] - r["start"]
        assert got == brute_spans(docs, 30)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_automata_find_phrases_where_they_were_not_selected():
    rng = random.Random(1)
    run, phrase = 30, 15
    text = "".join(rng.choice("abcdefgh") for _ in range(60))
    hasher = spans.Hasher(1 << 12)
    one = spans.Piece([(1, 0, text)], run, phrase, hasher)
    at = int(np.flatnonzero(one.sel)[0])
    gram = text[at : at + phrase]
    for _ in range(200):  # a text that holds the phrase but selects others everywhere
        other = "".join(rng.choice("abcdefgh") for _ in range(20)) + gram + "".join(rng.choice("abcdefgh") for _ in range(20))
        two = spans.Piece([(1, 0, text), (2, 0, other)], run, phrase, hasher)
        there = len(text) + 20
        if not two.sel[there]:
            break
    assert not two.sel[there]
    hits = spans._hits([two], one.h[[at]], phrase)[0]
    assert {at, there} <= set(hits) and all(two.text[i : i + phrase] == gram for i in hits)


def test_equal_hashes_of_different_texts_are_not_taken_for_equal(spark, monkeypatch):
    """Every window has one hash: only the comparison of characters tells them apart."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab") for _ in range(40)) for _ in range(3)]
    rows = [(1, i, 0, i, i, t) for i, t in enumerate([*texts, texts[0][:35] + "xxxxx"])]
    import pyarrow as pa

    flat = spans._window_rows
    monkeypatch.setattr(spans, "_window_rows", lambda t, run: (*flat(t, run)[:3], np.zeros(len(flat(t, run)[3]), np.uint64) + flat(t, run)[2].astype(np.uint64)))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["h", "x", "y", "lo", "hi", "passage"])
    got = [tuple(r.values()) for b in spans._compared(30)(iter([batch])) for r in b.to_pylist()]
    assert {g[1] for g in got} <= {0, 3} and all(g[3] == 0 and g[4] <= 5 for g in got)
