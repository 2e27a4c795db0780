"""Entity vectors: text encoding, neighbour aggregation with learned weights, similarity search."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripleloom.operators.ordered import sequence
from tripleloom.operators.store import top_per_key
from tripleloom.schema import NOISE_PREDICATES, UNSERIALISED
from tripleloom.session import materialise, shuffle_partitions

#: Rows of a cell of a blocked search: data rows and query rows that one task multiplies.
DATA_CELL, QUERY_CELL = 20_000, 2_000
#: Inputs that pairs are told apart from, of which each pair gets some in each epoch.
POOL = 256
#: Pairs, on average, of a unit of training: a row that has each input of its pairs once.
UNIT_PAIRS = 1000
#: Texts that are encoded together.
TEXTS = 256
#: Walks dealt out to the nodes of a graph, and those of a node at most.
WALKS, NODE_WALKS = 200, 50


@lru_cache(maxsize=1 << 18)
def _slot(gram: str) -> tuple[int, float]:
    """A gram's hash and sign; there are far fewer different grams than grams."""
    h = int.from_bytes(hashlib.blake2b(gram.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    return h >> 1, 1.0 if h & 1 else -1.0


class NGramEncoder:
    """Deterministic offline encoder: hashed character n-grams, unit length. Any object with ``dim``
    and ``encode(list of texts) -> array`` may stand in its place."""

    def __init__(self, dim: int = 384, n: int = 2):
        self.dim, self.n = dim, n

    def encode(self, texts: list[str]) -> np.ndarray:
        parts = [self._counts(texts[i : i + TEXTS]) for i in range(0, len(texts), TEXTS)]
        out = np.concatenate(parts) if parts else np.zeros((0, self.dim), np.float32)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    def _counts(self, texts: list[str]) -> np.ndarray:
        """Signed counts of the texts' grams by slot; a gram is hashed once, however often it comes."""
        texts = [f" {(t or '').lower()} " for t in texts]
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        lengths = np.array([len(t) for t in texts])
        row = np.repeat(np.arange(len(texts)), lengths)
        at, gram = np.arange(max(len(chars) - self.n + 1, 0)), None
        at = at[row[at] == row[at + self.n - 1]]  # grams within a text
        for j in range(self.n):  # numbers of grams of j + 1 characters
            gram = chars[at + j] if gram is None else (gram << 21) | chars[at + j]
            if j and j < self.n - 1:
                gram = np.unique(gram, return_inverse=True)[1]
        _, first, gram = np.unique(gram, return_index=True, return_inverse=True)
        slots = [_slot("".join(map(chr, chars[i : i + self.n]))) for i in at[first]]
        slot, sign = np.array([h % self.dim for h, _ in slots], np.int64), np.array([x for _, x in slots])
        return np.bincount(row[at] * self.dim + slot[gram], sign[gram], len(texts) * self.dim).reshape(-1, self.dim).astype(np.float32)


def encode(df: DataFrame, text: str, encoder, out: str = "vec") -> DataFrame:
    """``df`` with the vector of a text column, batch by batch."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(list(encoder.encode(s.fillna("").tolist())))

    return df.withColumn(out, run(F.col(text)))


def entity_texts(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, text): the id, then its eight most confident facts with their evidence, joined by ' | '."""
    top = top_per_key(
        triples.select("subject", "predicate", "object", "evidence", "confidence", "triple_id", *[c for c in ("row_id",) if c in triples.columns]),
        ["subject"], [F.desc_nulls_last("confidence"), F.col("triple_id"), *[F.col(c) for c in ("row_id",) if c in triples.columns]], 8,
    )
    rank = F.struct((-F.coalesce("confidence", F.lit(-1.0))).alias("c"), F.col("triple_id"), *[F.col(c) for c in ("row_id",) if c in triples.columns])
    parts = (
        F.when(F.col("predicate").isin(UNSERIALISED), F.array().cast("array<string>"))
        .otherwise(F.array_compact(F.array(F.concat(F.col("predicate"), F.lit(": "), F.col("object")), F.when(F.length("evidence") > 10, F.substring("evidence", 1, 120)))))
    )
    texts = (  # eight at most
        top.select("subject", F.struct(rank.alias("r"), parts.alias("p")).alias("x"))
        .groupBy("subject")
        .agg(F.array_sort(F.collect_list("x")).alias("xs"))
    )
    joined = texts.select(F.col("subject").alias("id"), F.flatten(F.transform("xs", lambda x: x["p"])).alias("ps"))
    ids = entities.select("id").filter("id is not null").distinct()
    return ids.join(joined, "id", "left").select("id", F.concat_ws(" | ", "id", F.coalesce("ps", F.array().cast("array<string>"))).alias("text"))


def adjacency(triples: DataFrame, ids: DataFrame, noise: list[str] = NOISE_PREDICATES) -> DataFrame:
    """(src, dst), both directions, distinct, no loops: edges between given ids (id) of predicates that are no noise."""
    e = (
        triples.filter(~F.col("predicate").isin(noise))
        .filter("subject <> object")
        .select(F.least("subject", "object").alias("a"), F.greatest("subject", "object").alias("b"))
        .distinct()
    )
    have = ids.select("id").distinct()
    e = e.join(have.withColumnRenamed("id", "a"), "a", "left_semi").join(have.withColumnRenamed("id", "b"), "b", "left_semi")
    return (
        e.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e"))
        .select("e.src", "e.dst")
    )


def _vectors(column: pa.Array, rows: int) -> np.ndarray:
    """A column of vectors, arrays or the bytes of floats of double precision, as rows."""
    flat = np.frombuffer(b"".join(column.to_pylist()), np.float64) if pa.types.is_binary(column.type) else column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(rows, -1)


def _blobs(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums of vectors by key within a batch: what travels is one row a key and batch."""
    for b in batches:
        if b.num_rows:
            keys = b.column("src").dictionary_encode()
            s = _at(_vectors(b.column("vec"), b.num_rows), keys.indices.to_numpy(), len(keys.dictionary))
            n = np.bincount(keys.indices.to_numpy(), minlength=len(keys.dictionary))
            yield pa.RecordBatch.from_arrays([keys.dictionary, _blobs(s), pa.array(n, pa.int64())], ["src", "s", "n"])


def _means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums sorted by key -> means, a batch and one key held at a time."""

    def rows(keys: list[str], s: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        mean = s / n[:, None]
        ends = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * mean.shape[1])
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.ListArray.from_arrays(ends, pa.array(mean.ravel()))], ["id", "mean"])

    key, total, count = None, None, None
    for b in batches:
        if not b.num_rows:
            continue
        runs = b.column("src").dictionary_encode()  # numbered in the order of the keys
        keys, at = runs.dictionary.to_pylist(), runs.indices.to_numpy()
        s, n = _at(_vectors(b.column("s"), b.num_rows), at, len(keys)), np.bincount(at, b.column("n").to_numpy(), len(keys))
        if key == keys[0]:
            s[0], n[0] = s[0] + total, n[0] + count
        elif key is not None:
            yield rows([key], total[None], np.array([count]))
        if len(keys) > 1:
            yield rows(keys[:-1], s[:-1], n[:-1])
        key, total, count = keys[-1], s[-1].copy(), n[-1]
    if key is not None:
        yield rows([key], total[None], np.array([count]))


def neighbour_means(vectors: DataFrame, adj: DataFrame) -> DataFrame:
    """(id, mean): element-wise mean of the neighbours' vectors; ids without neighbours have no row.

    Sums are combined in two steps, per batch and then per id as a stream, so a hub with very many
    neighbours is added up where its neighbours are and sends one row a batch.
    """
    part = adj.join(vectors.select(F.col("id").alias("dst"), "vec"), "dst").select(F.col("src").cast("string"), "vec").mapInArrow(_sums, "src string, s binary, n long")
    part = part.withColumn("at", F.monotonically_increasing_id())  # one order of adding up
    return part.repartition("src").sortWithinPartitions("src", "at").mapInArrow(_means, "id string, mean array<double>")


def walk_pairs(adj: DataFrame, per_node: int | None = None, length: int = 5, seed: int = 42) -> DataFrame:
    """(src, dst, n): how often seeded random walks step from src to dst. The neighbours of a node are
    numbered once; a step takes the one whose number a hash of (walk, step) gives, so it depends on no order of
    rows, and a walk at a hub meets one row instead of all the hub's neighbours.
    ``per_node`` walks start at each node; by default ``WALKS`` are dealt out, 1 to ``NODE_WALKS`` a node."""
    numbered = materialise(sequence(adj.select("src", "dst"), ["src"], ["dst"], "dst", "arcs").select("src", "dst", "pos"), "arcs")
    degree = materialise(numbered.groupBy("src").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("d")), "degrees")
    if per_node is None:
        per_node = max(1, min(NODE_WALKS, WALKS // max(1, degree.limit(WALKS + 1).count())))
    walks = degree.select(F.col("src").alias("start"), F.explode(F.sequence(F.lit(1), F.lit(per_node))).alias("walk"), F.col("src").alias("at"))
    steps = None
    for s in range(length):
        pick = F.col("first") + F.pmod(F.xxhash64(F.lit(seed), "start", "walk", F.lit(s)), "d")
        there = walks.join(degree, walks["at"] == degree["src"]).select("start", "walk", pick.alias("pos"))
        nxt = materialise(there.join(numbered, "pos").select("start", "walk", "src", "dst"), "walk")
        steps = nxt if steps is None else steps.union(nxt)
        walks = nxt.select("start", "walk", F.col("dst").alias("at"))
    return steps.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def initial_weights(dim: int, seed: int = 42) -> np.ndarray:
    """(dim, 2 dim): near the identity on the own vector, small noise elsewhere."""
    w = np.random.default_rng(seed).normal(0.0, 0.01, (dim, 2 * dim))
    w[:, :dim] += np.eye(dim)
    return w.astype(np.float32)


def save_weights(spark: SparkSession, path: str, w: np.ndarray) -> None:
    spark.createDataFrame([(w.shape[0], w.shape[1], [float(x) for x in w.ravel()])], "rows int, cols int, w array<float>").write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str, dim: int) -> np.ndarray | None:
    """Stored weights if there are any of the shape (dim, 2 dim)."""
    try:
        r = spark.read.parquet(path).first()
    except Exception:  # noqa: BLE001  never trained
        return None
    return np.array(r["w"], np.float32).reshape(r["rows"], r["cols"]) if r and (r["rows"], r["cols"]) == (dim, 2 * dim) else None


def forward(concat: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit vectors, pre-activations, norms) of one layer: W times (own, neighbour mean), ReLU, L2."""
    pre = concat @ w.T
    act = np.maximum(pre, 0)
    norm = np.linalg.norm(act, axis=1, keepdims=True)
    norm = np.where(norm > 0, norm, 1)
    return act / norm, pre, norm


def gradient(
    u: np.ndarray, v: np.ndarray, n: np.ndarray, negatives: np.ndarray, w: np.ndarray, apart: np.ndarray | None = None,
) -> tuple[np.ndarray, float, float]:
    """Gradient, loss and weight of a batch of pairs: rows of u and v are inputs (own, mean), n their
    counts. ``apart`` (pairs x negatives) says how often a pair is told apart from each of the inputs
    ``negatives``; None is once from all."""
    zu, pu, nu = forward(u, w)
    zv, pv, nv = forward(v, w)
    zn, pn, nn = forward(negatives, w)
    dot, off = (zu * zv).sum(1), zu @ zn.T
    sp, sn = 1 / (1 + np.exp(-dot)), 1 / (1 + np.exp(off))
    often = n[:, None] if apart is None else n[:, None] * apart
    loss = float((n * -np.log(sp + 1e-12)).sum() + (often * -np.log(sn + 1e-12)).sum())
    cp, cn = (-(1 - sp) * n)[:, None], (1 - sn) * often
    gu, gv, gn = cp * zv + cn @ zn, cp * zu, cn.T @ zu
    total = np.zeros(w.shape, np.float64)
    for g, z, p, norm, x in ((gu, zu, pu, nu, u), (gv, zv, pv, nv, v), (gn, zn, pn, nn, negatives)):
        back = (g - z * (g * z).sum(1, keepdims=True)) / norm * (p > 0)
        total += back.T @ x
    return total, loss, float(n.sum())


def _at(g: np.ndarray, keys: np.ndarray, rows: int) -> np.ndarray:
    """Sums of the rows of ``g`` by key, for keys 0 to ``rows`` - 1."""
    out = np.zeros((rows, g.shape[1]), g.dtype)
    order = np.argsort(keys, kind="stable")
    keys, starts = np.unique(keys[order], return_index=True)
    out[keys] = np.add.reduceat(g[order], starts, axis=0)
    return out


def unit_gradient(
    x: np.ndarray, u: np.ndarray, v: np.ndarray, n: np.ndarray, apart: np.ndarray, pool: np.ndarray, w: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, float]:
    """What ``gradient`` gives for the pairs (``x[u]``, ``x[v]``), but every input goes through the layer once, whatever number
    of pairs it is in, and the part of ``pool`` is left to the caller: the gradient of the weights without it, that of the unit vectors
    ``pool``, and the loss. ``apart`` (inputs x pool) says how often each input is told apart from each of the pool, counts included."""
    z, p, norm = forward(x, w)
    own = np.flatnonzero(apart.any(1))
    zu, zv, zo, often = z[u], z[v], z[own], apart[own]
    dot, off = np.einsum("ij,ij->i", zu, zv), zo @ pool.T
    sp, sn = 1 / (1 + np.exp(-dot)), 1 / (1 + np.exp(off))
    loss = float((n * -np.log(sp + 1e-12)).sum(dtype=np.float64) + (often * -np.log(sn + 1e-12)).sum(dtype=np.float64))
    cp, cn = (-(1 - sp) * n)[:, None].astype(z.dtype), ((1 - sn) * often).astype(z.dtype)
    g = _at(cp * zv, u, len(x)) + _at(cp * zu, v, len(x))
    g[own] += cn @ pool
    return _back(g, z, p, norm).T @ x, cn.T @ zo, loss


def _back(g: np.ndarray, z: np.ndarray, p: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """The gradient of a layer's pre-activations from that of its unit vectors."""
    return (g - z * np.einsum("ij,ij->i", g, z)[:, None]) / norm * (p > 0)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, vec, mean) -> (id, x): both vectors as the bytes of one array of floats."""
    for b in batches:
        if b.num_rows:
            x = np.hstack([np.asarray(b.column(c).flatten(), np.float32).reshape(b.num_rows, -1) for c in ("vec", "mean")])
            ends = pa.py_buffer(np.arange(b.num_rows + 1, dtype=np.int32) * (4 * x.shape[1]))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.Array.from_buffers(pa.binary(), b.num_rows, [None, ends, pa.py_buffer(x)])], ["id", "x"])


def units(pairs: DataFrame, inputs: DataFrame) -> DataFrame:
    """(x, u, v, n, k): ``pairs`` (src, dst, n, k) in units of some ``UNIT_PAIRS``, all pairs of a src in one. ``x`` is the bytes of the
    inputs (id, x) that the unit's pairs meet, each once, u and v the places in it of each pair; pairs without input are left out."""
    count = max(1, -(-pairs.count() // UNIT_PAIRS))
    p = pairs.withColumn("g", F.pmod(F.xxhash64("src"), F.lit(count)))
    met = p.select(F.col("g").alias("of"), F.explode(F.array("src", "dst")).alias("id")).distinct().join(inputs, "id")

    def unit(x: pa.Table, p: pa.Table) -> pa.Table:
        ids = np.array(x.column("id").to_pylist(), object)
        order = np.argsort(ids)
        at = {i: place for place, i in enumerate(ids[order])}
        rows = sorted((at[s], at[d], n, k) for s, d, n, k in zip(*(p.column(c).to_pylist() for c in ("src", "dst", "n", "k")), strict=True) if s in at and d in at)
        out = {"x": b"".join(x.column("x").take(pa.array(order)).to_pylist())}
        for i, (name, kind) in enumerate((("u", np.int32), ("v", np.int32), ("n", np.float32), ("k", np.int64))):
            out[name] = np.array([r[i] for r in rows], kind).tobytes()
        return pa.table({c: pa.array([b] if rows else [], pa.binary()) for c, b in out.items()})

    return met.groupBy("of").cogroup(p.groupBy("g")).applyInArrow(unit, "x binary, u binary, v binary, n binary, k binary")


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of a partition's gradients, losses and weights."""
    total, loss, n = None, 0.0, 0.0
    for b in batches:
        for g, x, m in zip(b.column("g"), b.column("loss").to_pylist(), b.column("n").to_pylist(), strict=True):
            g = np.frombuffer(g.as_buffer())
            total = g.copy() if total is None else total + g
            loss, n = loss + x, n + m
    if total is not None:
        yield _gradient_row(total, loss, n)


def _gradient_row(total: np.ndarray, loss: float, n: float) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_blobs(total.reshape(1, -1)), pa.array([loss]), pa.array([n])], ["g", "loss", "n"])


def train(vectors: DataFrame, adj: DataFrame, epochs: int = 30, rate: float = 0.5, negatives: int = 10, seed: int = 42) -> tuple[np.ndarray, list[float]]:
    """Aggregator weights and the loss of each epoch. The weights (dim x 2 dim) are the only thing the
    driver holds; each epoch adds up gradients of the partitions in two steps on the executors. A pair is
    told apart from ``negatives`` inputs (the sum over all pairs, a unit of them at a time), chosen anew each epoch by its hash out of ``POOL``. Where a step
    made the loss larger, the next one starts from the best weights so far with half the rate; the best are returned."""
    inputs = materialise(vectors.join(neighbour_means(vectors, adj), "id").select("id", "vec", "mean").mapInArrow(_packed, "id string, x binary"), "inputs")
    first = inputs.head(1)
    dim = len(vectors.head(1)[0]["vec"]) if first else 1
    w, losses = initial_weights(dim, seed), []
    if not first:
        return w, losses
    pairs = materialise(walk_pairs(adj, None, 5, seed).withColumn("k", F.xxhash64(F.lit(seed), "src", "dst")), "met")
    rows = materialise(units(pairs, inputs), "units")
    far = inputs.select("x", F.xxhash64(F.lit(seed), "id").alias("h"), "id").orderBy("h", "id").limit(POOL).collect()
    pool = np.stack([np.frombuffer(r["x"], np.float32) for r in far])
    best, held, step = math.inf, w, None
    for epoch in range(epochs):

        def part(batches: Iterator[pa.RecordBatch], w: np.ndarray = w, epoch: int = epoch) -> Iterator[pa.RecordBatch]:
            total, loss, weight = np.zeros(w.shape), 0.0, 0.0
            zn, pn, nn = forward(pool, w)
            gn = np.zeros(zn.shape)
            for b in batches:
                for r in range(b.num_rows):
                    x, u, v, n, k = (np.frombuffer(b.column(c)[r].as_buffer(), t) for c, t in (("x", np.float32), ("u", np.int32), ("v", np.int32), ("n", np.float32), ("k", np.uint64)))
                    x = x.reshape(-1, 2 * dim)
                    apart = np.zeros(len(x) * len(pool))
                    for i in range(negatives):
                        h = (k + np.uint64(epoch * negatives + i + 1)) * np.uint64(0x9E3779B97F4A7C15)
                        to = ((h >> np.uint64(33)) % np.uint64(len(pool))).astype(np.int64)
                        apart += np.bincount(u * np.int64(len(pool)) + to, n, len(apart))
                    g, far, lost = unit_gradient(x, u, v, n, apart.reshape(len(x), len(pool)), zn, w)
                    total, gn, loss, weight = total + g, gn + far, loss + lost, weight + float(n.sum())
            total += _back(gn, zn, pn, nn).T @ pool
            yield _gradient_row(total, loss, weight)

        shape = "g binary, loss double, n double"
        parts = rows.mapInArrow(part, shape)  # one gradient a partition
        few = max(1, math.isqrt(shuffle_partitions(rows.sparkSession)))
        parts = (  # one row
            parts.withColumn("at", F.spark_partition_id())
            .repartition(few, "at")
            .sortWithinPartitions("at")
            .mapInArrow(_added, shape)
            .coalesce(1)
            .mapInArrow(_added, shape)
            .collect()
        )
        n = sum(p["n"] for p in parts) or 1.0
        losses.append(sum(p["loss"] for p in parts) / n)
        if losses[-1] < best:
            best, held, step = losses[-1], w, np.sum([np.frombuffer(p["g"]) for p in parts], axis=0).reshape(w.shape) / n
        else:
            rate /= 2
        w = (held - rate * step).astype(np.float32) if step is not None else w
    return held, losses


def aggregate(vectors: DataFrame, adj: DataFrame, w: np.ndarray, layers: int = 2) -> DataFrame:
    """(id, vec): ``layers`` rounds with shared weights; ids without neighbours keep their unit vector."""

    def layer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            own = np.stack(f["vec"].to_numpy()).astype(np.float64)
            norm = np.linalg.norm(own, axis=1, keepdims=True)
            out = own / np.where(norm > 0, norm, 1)
            has = f["mean"].notna().to_numpy()
            if has.any():
                out[has] = forward(np.hstack([own[has], np.stack(f["mean"][has].to_numpy())]), w)[0]
            yield pd.DataFrame({"id": f["id"], "vec": list(out.astype(np.float32))})

    for _ in range(layers):
        vectors = materialise(
            vectors.join(neighbour_means(vectors, adj), "id", "left").select("id", "vec", "mean").mapInPandas(layer, "id string, vec array<float>"),
            "layer",
        )
    return vectors


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def quantise(x: np.ndarray, bits: int = 4) -> np.ndarray:
    """Each row scaled to whole numbers of so many bits; cosines of the result are near the true ones."""
    top = 2 ** (bits - 1) - 1
    scale = np.abs(x).max(axis=1, keepdims=True)
    return np.rint(x / np.where(scale > 0, scale, 1) * top).astype(np.int8)


def nearest(data: DataFrame, queries: DataFrame, k: int = 10, same_group: bool = False, quantised: bool = False) -> DataFrame:
    """(query, id, score, rank): for each query its k nearest rows by cosine, itself left out.

    ``data`` and ``queries`` have (id, vec, [grp]); null vectors are left out. Rows are cut into cells
    by hash, queries into blocks; each (cell, block) is one matrix product whose k best per query go
    on, then the best of all cells are taken. ``quantised`` first looks for 4 k by 4-bit vectors and
    ranks these exactly. Ties go to the smaller id.
    """
    group = ["grp"] if same_group else []
    d, q = (x.filter("vec is not null").select("id", "vec", *group) for x in (data, queries))
    cells = max(1, -(-d.count() // DATA_CELL))
    blocks = max(1, -(-q.count() // QUERY_CELL))
    dc = d.withColumn("cell", F.pmod(F.xxhash64("id"), F.lit(cells))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # other names than the data's: queries are mostly rows of the same table
    q = q.select(F.col("id").alias("q_id"), F.col("vec").alias("q_vec"), *[F.col(g).alias(f"q_{g}") for g in group])
    qc = (
        q.withColumn("block", F.pmod(F.xxhash64("q_id"), F.lit(blocks)).cast("int"))
        .withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))))
    )
    wide = 4 * k if quantised else k

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": [], "id": [], "score": []})
        right = right.sort_values("id", ignore_index=True)
        a, b = (np.stack(x.to_numpy()).astype(np.float64) for x in (left["q_vec"], right["vec"]))
        a, b = _unit(a), _unit(b)
        s = _unit(quantise(a).astype(np.float32)) @ _unit(quantise(b).astype(np.float32)).T if quantised else a @ b.T
        bad = left["q_id"].to_numpy()[:, None] == right["id"].to_numpy()[None, :]
        if same_group:
            bad |= left["q_grp"].to_numpy()[:, None] != right["grp"].to_numpy()[None, :]
        s = np.where(bad, -np.inf, s)
        top = np.argsort(-np.round(s, 9), axis=1, kind="stable")[:, :wide]
        rows = np.repeat(np.arange(len(left)), top.shape[1])
        cols = top.ravel()
        ok = np.isfinite(s[rows, cols])
        rows, cols = rows[ok], cols[ok]
        exact = np.einsum("ij,ij->i", a[rows], b[cols])
        return pd.DataFrame({"query": left["q_id"].to_numpy()[rows], "id": right["id"].to_numpy()[cols], "score": exact})

    kind = dict(d.dtypes)["id"]
    near = qc.groupBy("cell", "block").cogroup(dc.groupBy("cell", "block")).applyInPandas(cell, f"query {kind}, id {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k)
