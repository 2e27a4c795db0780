"""Training in units that hold each input once, against the gradient pair by pair; grams encoded together, against one by one."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from tripleloom.operators import vectors


def test_a_unit_has_the_gradient_of_its_pairs():
    r, dim = np.random.default_rng(1), 12
    x, pool, w = r.normal(size=(40, 2 * dim)), r.normal(size=(9, 2 * dim)), vectors.initial_weights(dim).astype(float)
    u, v, n, apart = np.sort(r.integers(0, 10, 60)), r.integers(5, 40, 60), r.integers(1, 4, 60).astype(float), r.integers(0, 3, (60, 9)).astype(float)
    want, loss, _ = vectors.gradient(x[u], x[v], n, pool, w, apart)
    often = np.zeros((40, 9))
    np.add.at(often, u, n[:, None] * apart)
    z, p, norm = vectors.forward(pool, w)
    g, far, lost = vectors.unit_gradient(x, u, v, n, often, z, w)
    assert np.allclose(g + vectors._back(far, z, p, norm).T @ pool, want) and np.isclose(lost, loss)


def test_units_hold_all_pairs_and_each_input_once(spark, monkeypatch):
    monkeypatch.setattr(vectors, "UNIT_PAIRS", 20)
    rng = random.Random(2)
    pairs = sorted({(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(200)})
    inputs = {f"n{i}": np.float32([i, i + 0.5]).tobytes() for i in range(30)}
    made = vectors.units(
        spark.createDataFrame([(a, b, i + 1, i) for i, (a, b) in enumerate(pairs)], "src string, dst string, n long, k long"), spark.createDataFrame(list(inputs.items()), "id string, x binary"),
    ).collect()
    got = []
    for row in made:
        x = [int(i) for i in np.frombuffer(row["x"], np.float32)[::2]]
        assert len(set(x)) == len(x)
        got += [(f"n{x[a]}", f"n{x[b]}", n, k) for a, b, n, k in zip(*(np.frombuffer(row[c], t) for c, t in (("u", np.int32), ("v", np.int32), ("n", np.float32), ("k", np.int64))), strict=True)]
    assert len(made) > 3 and sorted(got) == sorted((a, b, i + 1, i) for i, (a, b) in enumerate(pairs))


def test_texts_encoded_together_are_counted_gram_by_gram():
    rng = random.Random(3)
    texts = ["", None, "a", "Ünï \ud800 x😀y"] + ["".join(rng.choice("abcdef gh:é01") for _ in range(rng.randint(0, 200))) for _ in range(300)]
    for n in (1, 2, 4):
        want = np.zeros((len(texts), 48), np.float32)
        for row, t in zip(want, texts, strict=True):
            t = f" {(t or '').lower()} "
            for gram, times in Counter(t[i : i + n] for i in range(len(t) - n + 1)).items():
                h = int.from_bytes(hashlib.blake2b(gram.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
                row[(h >> 1) % 48] += times if h & 1 else -times
        norm = np.linalg.norm(want, axis=1, keepdims=True)
        assert (vectors.NGramEncoder(48, n).encode(texts) == want / np.where(norm > 0, norm, 1)).all()


def test_means_go_on_over_borders_of_batches():
    sums = lambda keys, x: pa.RecordBatch.from_arrays([pa.array(keys), vectors._blobs(np.float64(x)), pa.array([2] * len(keys), pa.int64())], ["src", "s", "n"])
    batches = [sums(["a", "b"], [[2, 4], [1, 1]]), sums(["b"], [[3, 3]]), sums(["b", "c", "c", "d"], [[8, 2], [1, 0], [3, 8], [2, 2]])]
    got = [r for b in vectors._means(iter(batches)) for r in b.to_pylist()]
    assert got == [{"id": "a", "mean": [1, 2]}, {"id": "b", "mean": [2, 1]}, {"id": "c", "mean": [1, 2]}, {"id": "d", "mean": [1, 1]}]
