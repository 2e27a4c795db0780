"""Vector index: inverted cells.

Centroids are fitted on a bounded sample (``SAMPLE`` rows with the least hashes); every row of the data is
put into the cell of its nearest centroid. A search looks into the cells nearest to the query and ranks
their rows by the exact cosine. How many cells are probed is read off the sample: the least number that
holds ``TARGET`` of the true neighbours of some of its rows. ``recall`` measures a search against brute force.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripleloom.operators.vectors import DATA_CELL, _unit, nearest
from tripleloom.session import materialise

#: Rows that centroids are fitted on, rows of these whose neighbours choose the probes, cells at most.
SAMPLE, TRIALS, MOST_CELLS = 20_000, 200, 4096
#: Share of true neighbours that the probed cells must hold.
TARGET = 0.95


def _centroids(x: np.ndarray, k: int, rounds: int = 10, seed: int = 42) -> np.ndarray:
    """Spherical k-means of unit rows."""
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        at = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(np.bincount(at, minlength=k)[:, None] > 0, _unit(sums), c)
    return c


def _probes(x: np.ndarray, c: np.ndarray, k: int = 10) -> int:
    """The least number of cells in which TARGET of the sample's k nearest rows lie."""
    at = np.argmax(x @ c.T, axis=1)
    q = x[: min(TRIALS, len(x))]
    near = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, 1 : k + 1]
    order = np.argsort(-(q @ c.T), axis=1, kind="stable")
    rank = np.argsort(order, axis=1)
    need = np.sort(np.take_along_axis(rank, at[near], axis=1).ravel())
    return int(need[min(len(need) - 1, math.ceil(TARGET * len(need)) - 1)]) + 1 if len(need) else 1


class VectorIndex:
    """``rows``: (cell, id, vec, more columns of the data); ``centroids`` (cells x dim); ``probes`` cells a search."""

    def __init__(self, rows: DataFrame, centroids: np.ndarray, probes: int, counts: np.ndarray | None = None):
        self.rows, self.centroids, self.probes, self._counts = rows, centroids, probes, counts

    @property
    def counts(self) -> np.ndarray:
        """Rows of each cell."""
        if self._counts is None:
            self._counts = np.zeros(len(self.centroids), np.int64)
            for r in self.rows.groupBy("cell").count().collect():  # MOST_CELLS rows at most
                self._counts[r["cell"]] = r["count"]
        return self._counts

    def save(self, path: str) -> None:
        """A folder a cell, so that a search reads only what it probes."""
        self.rows.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
        spark = self.rows.sparkSession
        self.rows = spark.read.schema(self.rows.schema).parquet(f"{path}/cells")
        c = [(i, [float(v) for v in row], self.probes, int(n)) for i, (row, n) in enumerate(zip(self.centroids, self.counts, strict=True))]
        spark.createDataFrame(c, "cell int, c array<double>, probes int, n long").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        c = sorted(spark.read.parquet(f"{path}/centroids").collect(), key=lambda r: r["cell"])  # MOST_CELLS rows at most
        return cls(spark.read.parquet(f"{path}/cells"), np.array([r["c"] for r in c]), c[0]["probes"] if c else 1, np.array([r["n"] for r in c], np.int64))

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
        """(query, id, score, rank): the k best rows of the probed cells for each query (id, vec), itself left
        out. Where the probed cells have no more than k rows, further cells are probed. Null vectors are left
        out; ties go to the smaller id. A large cell is cut into parts."""
        d = self.rows.filter("vec is not null").select("cell", "id", "vec")
        kind = self.rows.schema["id"].dataType.simpleString()
        if not len(self.centroids):
            return d.select(F.col("id").alias("query"), "id", F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
        c, counts, n = self.centroids, self.counts, min(probes or self.probes, len(self.centroids))

        def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    x = _unit(np.stack(f["vec"].to_numpy()).astype(np.float64))
                    order = np.argsort(-(x @ c.T), axis=1, kind="stable")
                    held = np.cumsum(counts[order], axis=1) - counts[order]  # rows of the nearer cells
                    at, place = np.nonzero((np.arange(len(c)) < n) | (held <= k))
                    yield pd.DataFrame({"q_id": f["id"].to_numpy()[at], "q_vec": list(x[at]), "cell": order[at, place].astype(np.int32)})

        asked = materialise(queries.filter("vec is not null").select("id", "vec").mapInPandas(probe, f"q_id {kind}, q_vec array<double>, cell int"), "probes")
        met = d.join(F.broadcast(asked.select("cell").distinct()), "cell", "left_semi")  # MOST_CELLS rows at most
        sizes = met.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / DATA_CELL).cast("int").alias("parts"))
        asked = asked.join(F.broadcast(sizes), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        met = met.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).drop("parts")

        def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"query": [], "id": [], "score": []})
            right = right.sort_values("id", ignore_index=True)
            s = np.stack(left["q_vec"].to_numpy()) @ _unit(np.stack(right["vec"].to_numpy()).astype(np.float64)).T
            s = np.where(left["q_id"].to_numpy()[:, None] == right["id"].to_numpy()[None, :], -np.inf, s)
            top = np.argsort(-np.round(s, 9), axis=1, kind="stable")[:, :k]
            row = np.repeat(np.arange(len(left)), top.shape[1])
            score = s[row, top.ravel()]
            ok = np.isfinite(score)
            return pd.DataFrame({"query": left["q_id"].to_numpy()[row[ok]], "id": right["id"].to_numpy()[top.ravel()[ok]], "score": score[ok]})

        near = asked.groupBy("cell", "part").cogroup(met.groupBy("cell", "part")).applyInPandas(rank, f"query {kind}, id {kind}, score double")
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "id"))
        return near.withColumn("rank", place).filter(F.col("rank") <= k)

    def recall(self, queries: DataFrame, k: int = 10, probes: int | None = None) -> float:
        """The share of the true k nearest rows that ``search`` finds, over all ``queries``."""
        true = nearest(self.rows.select("id", "vec"), queries, k).select("query", "id")
        found = self.search(queries, k, probes).select("query", "id", F.lit(1).alias("hit"))
        r = true.join(found, ["query", "id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0]
        return 1.0 if r is None else r


def build(data: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> VectorIndex:
    """The index of ``data`` (id, vec, more columns); ``cells`` is the square root of the rows by default."""
    d = data.filter("vec is not null")
    schema = T.StructType([T.StructField("cell", T.IntegerType()), *d.schema.fields])
    n = d.count()
    if not n:
        return VectorIndex(d.sparkSession.createDataFrame([], schema), np.zeros((0, 0)), 1)
    drawn = d.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    x = _unit(np.array([r["vec"] for r in drawn], np.float64))
    c = _centroids(x, min(cells or math.ceil(math.sqrt(n)), MOST_CELLS, len(x)))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            at = np.argmax(_unit(np.stack(f["vec"].to_numpy()).astype(np.float64)) @ c.T, axis=1) if len(f) else []
            f.insert(0, "cell", np.asarray(at, np.int32))
            yield f

    return VectorIndex(d.mapInPandas(place, schema), c, _probes(x, c))
