"""Filling fixed-capacity containers with items (problem 8).

Method: large-item matching. Items above a third of the capacity are placed first: the largest left
opens a container and is matched with the largest that still fits beside it, so such items meet at
most twice in a container. Smaller items follow in order of size, each into the container with the
least sufficient gap.

Sizes are whole numbers up to the capacity, so the greedy runs on the histogram of sizes (at most
``capacity`` rows, whatever the number of items): equal items are placed in one step, and equal
containers are one class with a count. Its result is a plan "items number a..b of size s go into
containers c, c + 1, ..., k items each"; items are then numbered within their size without a hot
task and find their container by looking up the plan.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.llm.sizes import DEFAULT_VOCABULARY, with_tokens
from tripleloom.operators.ordered import sequence
from tripleloom.session import materialise


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (size, from_rank, n, first_bin, each): n items of the size from that rank on go into
    containers first_bin, first_bin + 1, ..., ``each`` into every one. Sizes are 1..capacity."""
    left = {s: n for s, n in histogram.items() if n}
    used = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> containers (first, count)
    bins = 0

    def put(size: int, n: int, first: int, each: int) -> None:
        rows.append((size, used[size], n, first, each))
        used[size] += n
        left[size] -= n

    def free(gap: int, first: int, count: int) -> None:
        if count:
            gaps.setdefault(gap, []).append((first, count))

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        a = large[-1]
        i = bisect.bisect_right(large, capacity - a) - 1
        if i < 0:  # nothing large fits beside it
            n = left[a]
            put(a, n, bins, 1)
            free(capacity - a, bins, n)
            bins += n
        elif large[i] == a:  # two of a kind
            n = left[a] // 2
            put(a, 2 * n, bins, 2) if n else None
            free(capacity - 2 * a, bins, n)
            bins += n
            if left[a]:  # the odd one is matched with the next smaller
                b = large[i - 1] if i else None
                put(a, 1, bins, 1)
                if b is not None:
                    put(b, 1, bins, 1)
                    if not left[b]:
                        large.remove(b)
                free(capacity - a - (b or 0), bins, 1)
                bins += 1
        else:
            b = large[i]
            n = min(left[a], left[b])
            put(a, n, bins, 1)
            put(b, n, bins, 1)
            free(capacity - a - b, bins, n)
            bins += n
            if not left[b]:
                large.remove(b)
        if not left[a]:
            large.remove(a)
    open_gaps = sorted(gaps)
    for s in sorted((s for s in left if left[s]), reverse=True):
        while left[s]:
            i = bisect.bisect_left(open_gaps, s)
            if i == len(open_gaps):  # no gap is large enough: new containers
                k = capacity // s
                n = left[s] // k
                if n:
                    put(s, n * k, bins, k)
                    fresh = [(capacity - k * s, bins, n)]
                    bins += n
                else:
                    fresh = []
                if left[s]:
                    r = left[s]
                    put(s, r, bins, r)
                    fresh.append((capacity - r * s, bins, 1))
                    bins += 1
            else:
                gap = open_gaps[i]
                first, count = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    open_gaps.pop(i)
                k = gap // s  # the least sufficient gap stays the least until it is too small
                n = min(count, left[s] // k)
                fresh = [(gap - k * s, first, n)] if n else []
                if n:
                    put(s, n * k, first, k)
                if n < count:
                    r = left[s]  # less than k items are left
                    if r:
                        put(s, r, first + n, r)
                        fresh.append((gap - r * s, first + n, 1))
                    rest = n + bool(r)
                    fresh.append((gap, first + rest, count - rest))
            for g, first, count in fresh:
                if count:
                    if g not in gaps:
                        bisect.insort(open_gaps, g)
                    free(g, first, count)
    return rows


def pack(items: DataFrame, capacity: int, label: str) -> DataFrame:
    """``items`` (id, n_tokens) -> (bin, id, piece, offset, size): offset and size in tokens.

    An item is split only if it alone exceeds the capacity: into pieces of full capacity and the
    rest. Items without tokens need no container and have no row. Repeated items are packed as often
    as they come. Ties: items of one size are taken in the order of id and piece.
    """
    spark = items.sparkSession
    whole = F.floor((F.col("n_tokens") - 1) / capacity).cast("int")
    pieces = items.filter("n_tokens > 0").select("id", "n_tokens", F.explode(F.sequence(F.lit(0), whole)).alias("piece"))
    offset = F.col("piece") * capacity
    pieces = pieces.select("id", "piece", offset.alias("offset"), F.least(F.lit(capacity), F.col("n_tokens") - offset).cast("int").alias("size"))
    numbered = sequence(pieces, [], ["size", "id", "piece"], "piece", label).drop("next_piece")
    numbered = materialise(numbered, f"{label}-ranked")
    bounds = numbered.groupBy("size").agg(F.min("pos").alias("p0"), F.count(F.lit(1)).alias("n")).collect()  # at most ``capacity`` rows
    start = {r["size"]: r["p0"] for r in bounds}
    rows = plan({r["size"]: r["n"] for r in bounds}, capacity)
    # a look-up by the item's global position: steps are sorted ranges, at most a few times ``capacity``
    steps = sorted((start[s] + a, n, b, k) for s, a, n, b, k in rows)
    if not steps:
        return numbered.select(F.col("pos").alias("bin"), "id", "piece", "offset", "size").limit(0)
    lows = spark.sparkContext.broadcast(steps)

    @F.pandas_udf("long")
    def container(pos):
        import numpy as np
        import pandas as pd

        table = np.array(lows.value, dtype=np.int64)
        i = np.searchsorted(table[:, 0], pos.to_numpy(), side="right") - 1
        return pd.Series(table[i, 2] + (pos.to_numpy() - table[i, 0]) // table[i, 3])

    return numbered.select(container("pos").alias("bin"), "id", "piece", "offset", "size")


def fill_containers(documents: DataFrame, containers: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(container, bin, doc_id, piece, token_offset, n_tokens) for every container of ``containers``.

    Documents with null ids are left out, those without tokens need no room. ``containers`` is a
    small table of settings (container, capacity_tokens); null or non-positive capacities are left out.
    """
    sized = materialise(with_tokens(documents.filter("doc_id is not null").select(F.col("doc_id").alias("id"), "text"), "text", ["id"], vocabulary), "sizes")
    out = None
    for c in containers.filter("capacity_tokens > 0").select("container", "capacity_tokens").distinct().orderBy("container", "capacity_tokens").collect():
        p = (
            pack(sized, c["capacity_tokens"], "items")
            .select(F.lit(c["container"]).alias("container"), "bin", F.col("id").alias("doc_id"), "piece", F.col("offset").alias("token_offset"), F.col("size").alias("n_tokens"))
        )
        out = p if out is None else out.union(p)
    if out is None:
        return (
            sized.select(
                F.lit("").alias("container"), F.col("id").alias("bin"), F.col("id").alias("doc_id"), F.lit(0).alias("piece"),
                F.lit(0).alias("token_offset"), "n_tokens",
            )
            .limit(0)
        )
    return out


def fill_report(filled: DataFrame, containers: DataFrame) -> DataFrame:
    """One row a container: bins, items, tokens, the share of room used and the least number of bins possible."""
    per = filled.groupBy("container").agg(F.countDistinct("bin").alias("bins"), F.count(F.lit(1)).alias("items"), F.sum("n_tokens").alias("tokens"))
    c = containers.select("container", "capacity_tokens").distinct()
    return (
        per.join(F.broadcast(c), "container")
        .select("container", "bins", "items", "tokens", F.round(F.col("tokens") / (F.col("bins") * F.col("capacity_tokens")), 6).alias("used"), F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_bins"))
    )
