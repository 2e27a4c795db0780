"""Communities of the semantic graph: weighted edges, hierarchical partition, facts and summaries.

Partition: modularity (resolution-weighted, RB configuration) by moving vertices between communities
in rounds that run as joins and aggregations over all edges, then contracting communities to
vertices, as in the Louvain and Leiden methods. Moves are made by half of the vertices a round (by
hash) at first, then only by those whose two communities no better move touches: such moves add up, so
each round gains and the rounds end when no vertex gains by a move. Parts that came apart are split
into their connected pieces, so every community is connected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.operators.graph import components
from tripleloom.operators.store import top_per_key
from tripleloom.schema import NOISE_PREDICATES, SEMANTIC_PREDICATES, STRONG_PREDICATES
from tripleloom.session import discard, materialise

#: Edges of a graph that one task partitions at most; the result does not depend on it.
LOCAL_EDGES = 200_000


def semantic_edges(triples: DataFrame) -> DataFrame:
    """(a, b, weight), a < b: semantic triples between different non-empty ends, strong ones count 2."""
    t = triples.filter(F.col("predicate").isin(SEMANTIC_PREDICATES)).filter("subject <> '' and object <> '' and subject <> object")
    w = F.when(F.col("predicate").isin(STRONG_PREDICATES), 2.0).otherwise(1.0)
    return t.groupBy(F.least("subject", "object").alias("a"), F.greatest("subject", "object").alias("b")).agg(F.sum(w).alias("weight"))


def _coin(r: int, level: int) -> int:
    """The bit of a vertex's hash that decides whether it may move in a round."""
    return (r + 7 * level) % 62


def _moves(edges: DataFrame, resolution: float, rounds: int, level: int) -> DataFrame:
    """(scope, v, c): communities of the vertices of one contracted graph; edges (scope, a, b, weight), both
    directions, loops once with double weight. ``scope`` keeps subgraphs apart, none depends on another.
    Half of the vertices may move in each of the first ``rounds`` rounds; then moves are exclusive.
    Gains are whole numbers of 1e-9, so that equal gains are equal here and in ``_local``."""
    degree = materialise(edges.groupBy("scope", F.col("a").alias("v")).agg(F.sum("weight").alias("d")), "degree")
    total = degree.groupBy("scope").agg(F.sum("d").alias("m2"))
    place = materialise(degree.select("scope", "v", F.col("v").alias("c"), "d"), "place")
    r = 0
    while True:
        size = place.groupBy("scope", "c").agg(F.sum("d").alias("s"))
        at = place.select("scope", F.col("v").alias("b"), F.col("c").alias("cb"))
        to = (
            edges.filter("a <> b")
            .join(at, ["scope", "b"])
            .groupBy("scope", F.col("a").alias("v"), F.col("cb").alias("target"))
            .agg(F.sum("weight").alias("k"))
        )
        own = place.select("scope", "v", F.col("c").alias("target"), F.lit(0.0).alias("k"))
        options = to.union(own).groupBy("scope", "v", "target").agg(F.sum("k").alias("k"))
        options = (
            options.join(place.select("scope", "v", "c", "d"), ["scope", "v"])
            .join(size.withColumnRenamed("c", "target"), ["scope", "target"])
            .join(total, "scope")
        )
        others = F.col("s") - F.when(F.col("target") == F.col("c"), F.col("d")).otherwise(0.0)
        gain = F.floor((F.col("k") - F.lit(resolution) * F.col("d") * others / F.col("m2")) * 1e9 + 0.5)
        best = (
            options.groupBy("scope", "v")
            .agg(F.max(F.struct(gain.alias("g"), (F.col("target") == F.col("c")).alias("stay"), F.col("target").alias("t"))).alias("x"), F.max(F.when(F.col("target") == F.col("c"), gain)).alias("here"), F.first("c").alias("c"), F.first("d").alias("d"))
        )
        best = materialise(best.select("scope", "v", "c", "d", F.col("x.t").alias("t"), (F.col("x.g") - F.col("here")).alias("more")), "best")
        wants = best.filter("t <> c")
        if not wants.head(1):
            break
        if r < rounds:
            go = wants.filter(F.shiftrightunsigned(F.xxhash64("v"), _coin(r, level)).bitwiseAND(F.lit(1)) == 1).select("scope", "v", "t")
        else:
            ends = wants.select("scope", "v", "t", "more", F.explode(F.array("c", "t")).alias("m"))
            top = ends.groupBy("scope", "m").agg(F.max(F.struct("more", "v")).alias("top"))
            go = ends.join(top, ["scope", "m"]).filter("top.v = v").groupBy("scope", "v", "t").agg(F.count(F.lit(1)).alias("k")).filter("k = 2").drop("k")
        after = materialise(best.drop("t").join(go, ["scope", "v"], "left").select("scope", "v", F.coalesce("t", "c").alias("c"), "d"), "place")
        discard(place, best)
        place = after
        r += 1
    return place.select("scope", "v", "c")


def _settle(a: np.ndarray, b: np.ndarray, w: np.ndarray, coins: np.ndarray, resolution: float, rounds: int, level: int) -> np.ndarray:
    """``_moves`` on one graph in memory: vertices are numbers in the order of their names."""
    n = len(coins)
    d = np.bincount(a, w, n)
    m2 = d.sum()
    c = np.arange(n)
    apart = a != b
    a, b, w = a[apart], b[apart], w[apart]
    r = 0
    while True:
        s = np.bincount(c, d, n)
        pair, at = np.unique(np.concatenate([a * n + c[b], np.arange(n) * n + c]), return_inverse=True)
        k = np.bincount(at, np.concatenate([w, np.zeros(n)]))
        v, t = pair // n, pair % n
        stay = t == c[v]
        others = s[t] - np.where(stay, d[v], 0.0)
        g = np.floor((k - resolution * d[v] * others / m2) * 1e9 + 0.5).astype(np.int64)
        order = np.lexsort((t, stay, g, v))
        last = order[np.append(np.flatnonzero(np.diff(v[order])), len(order) - 1)]  # the best option of each vertex
        to, more = t[last], g[last] - g[np.flatnonzero(stay)]
        wants = np.flatnonzero(to != c)
        if not len(wants):
            return c
        if r < rounds:
            go = wants[(coins[wants] >> np.uint64(_coin(r, level))) & np.uint64(1) == 1]
        else:
            m = np.concatenate([c[wants], to[wants]])
            who = np.concatenate([wants, wants])
            by = np.lexsort((who, more[who], m))
            top = np.full(n, -1)
            top[m[by]] = who[by]  # the last of each community is the best
            go = wants[(top[c[wants]] == wants) & (top[to[wants]] == wants)]
        c[go] = to[go]
        r += 1


def _local(resolution: float, rounds: int, level: int):
    """All levels of one small graph in one task: the same moves as the distributed rounds make."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(np.concatenate([frame["a"], frame["b"]]).astype(object), return_inverse=True)
        n = len(frame)
        coins = np.zeros(len(names), np.uint64)
        coins[at[:n]] = frame["coin"].to_numpy(np.int64).view(np.uint64)
        a, b, w = at[:n], at[n:], frame["weight"].to_numpy(float)
        member, label, step = np.arange(len(names)), np.arange(len(names)), level
        while True:
            c = _settle(a, b, w, coins[label], resolution, rounds, step)
            member = c[member]
            used, member = np.unique(member, return_inverse=True)
            number = np.full(len(label), -1)
            number[used] = np.arange(len(used))
            label = label[used]
            edges, inv = np.unique(number[c[a]] * len(used) + number[c[b]], return_inverse=True)
            stuck = len(edges) == len(a)
            a, b, w = edges // len(used), edges % len(used), np.bincount(inv, w)
            step += 1
            if stuck:
                break
        return pd.DataFrame({"scope": frame["scope"].iloc[0], "v": names, "c": names[label[member]]})

    return run


def partition(edges: DataFrame, resolution: float = 1.0, rounds: int = 12, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(scope, v, c): vertex to community of edges (scope, a, b, weight; a <> b, one direction).

    Vertices move, communities become vertices, until no vertex moves. Graphs of up to ``local_edges`` edges
    are moved in one task each, larger ones in distributed rounds: where the work is done, not what is
    done, so the result is the same (for weights whose sums are exact, as whole and half numbers are).
    Communities are connected and named by their least vertex; the result depends on no order of rows.
    """
    both = (
        edges.select("scope", F.explode(F.array(F.struct("a", "b", "weight"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))).alias("e"))
        .select("scope", "e.*")
    )
    live = materialise(both, "edges")
    member, level, before = None, 0, None
    while True:
        large = live.groupBy("scope").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
        if before is not None and large[1] == before:  # nothing was contracted
            break
        small = (large[0] or 0) <= 2 * local_edges
        if small:
            c = live.withColumn("coin", F.xxhash64("a")).groupBy("scope").applyInPandas(_local(resolution, rounds, level), "scope string, v string, c string")
        else:
            c = _moves(live, resolution, rounds, level)
        c = materialise(c, "moved")
        member = c if member is None else materialise(member.join(c.select("scope", F.col("v").alias("c"), F.col("c").alias("c2")), ["scope", "c"]).select("scope", "v", F.col("c2").alias("c")), "member")
        if small:
            break
        level, before = level + 1, large[1]
        x = c.select("scope", F.col("v").alias("a"), F.col("c").alias("ca"))
        y = c.select("scope", F.col("v").alias("b"), F.col("c").alias("cb"))
        after = materialise(
            live.join(x, ["scope", "a"]).join(y, ["scope", "b"]).groupBy("scope", F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("weight").alias("weight")),
            "edges",
        )
        discard(live)
        live = after
    # connected pieces within each community
    va = member.select("scope", F.col("v").alias("a"), F.col("c").alias("ca"))
    vb = member.select("scope", F.col("v").alias("b"), F.col("c").alias("cb"))
    sep = F.lit("\x1f")
    inside = (
        edges.join(va, ["scope", "a"])
        .join(vb, ["scope", "b"])
        .filter("ca = cb")
        .select(F.concat(F.col("scope"), sep, "a").alias("a"), F.concat(F.col("scope"), sep, "b").alias("b"))
    )
    pieces = components(inside)
    named = member.withColumn("key", F.concat(F.col("scope"), sep, "v")).join(pieces.withColumnRenamed("id", "key"), "key", "left")
    return named.select("scope", "v", F.coalesce(F.element_at(F.split("root", "\x1f"), -1), F.col("v")).alias("c"))


def hierarchy_levels(
    edges: DataFrame, min_size: int = 3, max_levels: int = 2, split_over: int | None = None, base: float = 1.0, step: float = 2.0,
) -> DataFrame:
    """(level, parent, community, entity): level 0 partitions the graph, each larger community is
    partitioned again at a higher resolution while that splits it, down to ``max_levels``.

    A community's name is its level and least member; those under ``min_size`` are left out.
    """
    over = split_over if split_over is not None else max(2 * min_size, 6)
    e = materialise(edges.select(F.lit("").alias("scope"), "a", "b", "weight"), "graph")
    out, scoped = None, e
    for level in range(max_levels + 1):
        part = materialise(partition(scoped, base * step**level), "level")
        parts = part.groupBy("scope").agg(F.countDistinct("c").alias("k"))
        if level:  # only where it really splits
            part = part.join(parts.filter("k > 1").select("scope"), "scope", "left_semi")
        name = F.concat(F.lit(f"L{level}:"), F.col("c"))
        here = part.select(
            F.lit(level).alias("level"), F.when(F.col("scope") != "", F.col("scope")).alias("parent"), name.alias("community"), F.col("v").alias("entity"),
        )
        here = materialise(here, "communities")
        out = here if out is None else out.union(here)
        if level == max_levels:
            break
        large = here.groupBy("community").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > over).select("community")
        inner = here.join(large, "community", "left_semi").select(F.col("community").alias("scope"), F.col("entity").alias("v"))
        ia, ib = inner.select(F.col("scope").alias("sa"), F.col("v").alias("a")), inner.select(F.col("scope").alias("sb"), F.col("v").alias("b"))
        scoped = materialise(e.drop("scope").join(ia, "a").join(ib, "b").filter("sa = sb").select(F.col("sa").alias("scope"), "a", "b", "weight"), "subgraphs")
        if not scoped.head(1):
            break
    return large_enough(out, min_size)


def large_enough(levels: DataFrame, min_size: int = 3) -> DataFrame:
    """The rows of communities with at least ``min_size`` members."""
    sizes = levels.groupBy("community").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_size)
    return levels.join(sizes.select("community"), "community", "left_semi").select("level", "parent", "community", "entity")


def community_tables(levels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(communities, community_members) in the store's columns; ids are numbered by level, size and name."""
    c = levels.groupBy("level", "parent", "community").agg(F.count(F.lit(1)).alias("member_count"))
    return c.select(F.col("community").alias("community_id"), "member_count", "level", F.col("parent").alias("parent_community_id")), levels.select(F.col("community").alias("community_id"), F.col("entity").alias("entity_id"))


def community_facts(triples: DataFrame, members: DataFrame, limit: int = 80) -> DataFrame:
    """(community_id, subject, predicate, object): distinct facts that touch a member, the first 80 of each
    community by predicate, subject and object. A prompt's limit, applied before the shuffle."""
    t = triples.filter(~F.col("predicate").isin(NOISE_PREDICATES)).select("subject", "predicate", "object").distinct()
    m = members.select("community_id", F.col("entity_id").alias("id")).distinct()
    sides = t.select(F.explode(F.array_distinct(F.array("subject", "object"))).alias("id"), "subject", "predicate", "object").join(m, "id").drop("id")
    return top_per_key(sides.distinct(), ["community_id"], ["predicate", "subject", "object"], limit).select("community_id", "subject", "predicate", "object")


def community_stats(communities: DataFrame) -> DataFrame:
    """communities, total_members (0 where there are none; members count on each of their levels)."""
    return communities.agg(F.count(F.lit(1)).alias("communities"), F.coalesce(F.sum("member_count"), F.lit(0)).cast("long").alias("total_members"))


def detection_stats(levels: DataFrame) -> DataFrame:
    """levels, communities, covered entities of a detection; zeros for an empty one."""
    return levels.agg(
        F.coalesce(F.max("level") + 1, F.lit(0)).alias("levels"), F.countDistinct("community").alias("communities"),
        F.countDistinct("entity").alias("covered"),
    )


def summaries(communities: DataFrame) -> DataFrame:
    """Communities that have a summary, in order of level and descending size (``place``)."""
    s = communities.filter("summary is not null and summary <> ''")
    return s.orderBy("level", F.desc("member_count"), "community_id")


def with_summaries(communities: DataFrame, said: DataFrame) -> DataFrame:
    """``communities`` with the summaries of ``said`` (community_id, summary) where it has one that is not null."""
    fresh = said.filter("summary is not null").groupBy("community_id").agg(F.max("summary").alias("_said"))
    return communities.join(fresh, "community_id", "left").withColumn("summary", F.coalesce("_said", "summary")).select(*communities.columns)


def summarise(facts: DataFrame, members: DataFrame, client) -> DataFrame:
    """(community_id, summary): ``client(prompt, system)`` over each community's facts, a call each on
    the executors; a failing call gives null, a community without facts ''."""
    names = (
        top_per_key(members.select("community_id", "entity_id").distinct(), ["community_id"], ["entity_id"], 20)
        .groupBy("community_id")
        .agg(F.array_join(F.array_sort(F.collect_list("entity_id")), ", ").alias("names"))
    )
    sizes = members.select("community_id", "entity_id").distinct().groupBy("community_id").agg(F.count(F.lit(1)).alias("n"))
    line = F.concat(F.lit("("), "subject", F.lit(")-["), "predicate", F.lit("]->("), "object", F.lit(")"))
    text = facts.groupBy("community_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("facts"))
    prompts = sizes.join(names, "community_id").join(text, "community_id", "left")

    def run(frames):
        for f in frames:
            out = []
            for cid, n, nm, fx in zip(f["community_id"], f["n"], f["names"], f["facts"], strict=True):
                if fx is None:
                    out.append("")
                    continue
                try:
                    out.append(client(f"Community {cid}, {n} entities: {nm}\n\nRelations:\n{fx}", "Summarise what these related entities have in common."))
                except Exception:  # noqa: BLE001  one failing call must not lose the others
                    out.append(None)
            yield pd.DataFrame({"community_id": f["community_id"], "summary": out})

    return prompts.select("community_id", "n", "names", "facts").mapInPandas(run, "community_id string, summary string")


