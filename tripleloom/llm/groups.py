"""Consolidating pairwise matches into groups (problem 2).

Method: two-dimensional grid. Vertices are hashed into B blocks, an edge falls into the cell of its
two blocks, and each cell runs union-find on its own edges. A vertex with very many edges is spread
over the B cells of its row and the B of its column; a cell that is still too large is cut by edges.
Then every vertex takes the first of the representatives that its row and column cells gave it, these
parents are followed until they stabilise, and what links two different parents is the next round's
edges. Rounds end when no link is left; then the parents are put together, round by round.

"First" is by a hash of the vertex that changes each round. Only a vertex that comes first among its
neighbours survives a round, whatever the order of the numbers, so a chain in order, a random one, a star
and a tree all shrink by a constant factor a round and the rounds are logarithmic.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.operators.ordered import sequence
from tripleloom.session import discard, materialise, shuffle_partitions

#: Edges that one cell should hold; the grid grows with the number of edges.
CELL_EDGES = 100_000
#: Blocks of the first round's grid at least, so that it is one where the parallelism is low.
FIRST_BLOCKS = 4


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """Another order of the vertices for each salt: one-to-one on 64 bits, so ties cannot occur."""
    h = x.astype(np.uint64) + np.uint64((salt * 2 + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h.view(np.int64)


def _union_find(u: np.ndarray, v: np.ndarray, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vertices, the first vertex (by ``_mix``) that the edges link them to, and that one's place in the order."""
    ids, flat = np.unique(_mix(np.concatenate([u, v]), salt), return_index=True)
    names = np.concatenate([u, v])[flat]
    at = np.searchsorted(ids, _mix(np.concatenate([u, v]), salt))
    a, b = at[: len(u)], at[len(u) :]
    parent = np.arange(len(ids))
    while len(a):  # hook the later root to the earlier one, then jump pointers
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(parent, hi, lo)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        a, b = parent[a], parent[b]
        open_ = a != b
        a, b = a[open_], b[open_]
    return names, names[parent], ids[parent]


def _cell(salt: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x, rep, place = _union_find(frame["u"].to_numpy(np.int64), frame["v"].to_numpy(np.int64), salt)
        return pd.DataFrame({"x": x, "rep": rep, "place": place})

    return run


def _cells(live: DataFrame, left: int, blocks: int, cell_edges: int) -> DataFrame:
    """``live`` with the cell of each edge: its two blocks, and a number where the two hold too many edges."""
    grid = F.pmod(F.xxhash64("u"), F.lit(blocks)) * blocks + F.pmod(F.xxhash64("v"), F.lit(blocks))
    placed = live.withColumn("cell", grid)
    if left <= cell_edges:
        return placed.withColumn("part", F.lit(0).cast("long"))
    parts = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / cell_edges).alias("parts")).filter("parts > 2")
    cut = F.pmod(F.xxhash64("u", "v", F.lit(1)), F.coalesce("parts", F.lit(1)))
    return placed.join(parts, "cell", "left").withColumn("part", cut.cast("long")).drop("parts")


def _stars(parents: DataFrame) -> DataFrame:
    """(x, parent) with every chain of parents followed to its end: each pass doubles the steps."""
    while True:
        up = parents.filter("x <> parent").select(F.col("x").alias("parent"), F.col("parent").alias("further"))
        stepped = parents.join(up, "parent", "left").select("x", F.coalesce("further", "parent").alias("parent"), F.col("further").isNotNull().alias("moved"))
        after = materialise(stepped, "parents")
        moved = after.filter("moved").head(1)
        discard(parents)
        parents = after.drop("moved")
        parents._scratch = after._scratch
        if not moved:
            return parents


def grid_components(edges: DataFrame, cell_edges: int = CELL_EDGES, log: list[int] | None = None) -> DataFrame:
    """(x, root): every vertex of ``edges`` (u, v; bigint, u <> v) with its component's least vertex.

    ``log`` gets the number of edges of each round.
    """
    live = materialise(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    rounds: list[DataFrame] = []
    while left := live.count():
        if log is not None:
            log.append(left)
        blocks = math.ceil(math.sqrt(left / cell_edges))
        if not rounds:
            blocks = max(blocks, FIRST_BLOCKS, math.ceil(math.sqrt(shuffle_partitions(edges.sparkSession))))
        cells = _cells(live, left, blocks, cell_edges).groupBy("cell", "part")
        reps = materialise(cells.applyInPandas(_cell(len(rounds)), "x long, rep long, place long"), "cells")
        discard(live)
        if blocks == 1 and left <= cell_edges:  # one cell saw every edge: its representatives are final
            rounds.append(reps.select("x", F.col("rep").alias("parent")))
            break
        first = materialise(reps.groupBy("x").agg(F.min(F.struct("place", "rep")).alias("m")).select("x", F.col("m.rep").alias("parent")), "parents")
        others = reps.join(first, "x").filter("rep <> parent").select("parent", "rep").distinct()
        others = materialise(others, "others")
        discard(reps)
        stars = _stars(first)
        rounds.append(stars)
        to = stars.select(F.col("x").alias("parent"), F.col("parent").alias("a"))
        to2 = stars.select(F.col("x").alias("rep"), F.col("parent").alias("b"))
        links = others.join(to, "parent").join(to2, "rep").filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
        live = materialise(links.distinct(), "links")
        discard(others)
    if not rounds:
        return edges.select(F.col("u").alias("x"), F.col("u").alias("root")).limit(0)
    known = rounds[-1].select("x", F.col("parent").alias("top"))
    for earlier in reversed(rounds[:-1]):
        above = known.select(F.col("x").alias("parent"), "top")
        known = materialise(earlier.join(above, "parent", "left").select("x", F.coalesce("top", "parent").alias("top")), "resolved")
    least = known.groupBy("top").agg(F.min("x").alias("root"))
    return materialise(known.join(least, "top").select("x", "root"), "roots")


def match_groups(pairs: DataFrame, a: str, b: str, cell_edges: int = CELL_EDGES) -> DataFrame:
    """(group_id, entity_id): every id that occurs in a row with both ids present, once, with the
    smallest id (by code points) of all ids linked to it.

    Rows with a null id are left out; an id linked only to itself is its own group; repeated and
    reversed pairs count once; empty text is an id. Other columns do not matter.
    """
    both = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    e = materialise(both.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct(), "pairs")
    ids = e.select("a").union(e.select("b")).distinct().withColumnRenamed("a", "id")
    numbered = materialise(sequence(ids, [], ["id"], "id", "ids").select("id", "pos"), "numbers")  # order of code points
    # The popular id is on the many side of these joins, where the adaptive plan splits it.
    left, right = numbered.select(F.col("id").alias("a"), F.col("pos").alias("u")), numbered.select(F.col("id").alias("b"), F.col("pos").alias("v"))
    roots = grid_components(e.filter("a <> b").join(left, "a").join(right, "b").select("u", "v"), cell_edges)
    member = numbered.join(roots.select(F.col("x").alias("pos"), "root"), "pos", "left").select("id", F.coalesce("root", "pos").alias("root"))
    heads = numbered.select(F.col("pos").alias("root"), F.col("id").alias("group_id"))
    return member.join(heads, "root").select("group_id", F.col("id").alias("entity_id"))
