"""Parent-child links to full hierarchies: root, depth, path, descendants, loops (problem 7).

Method: peel leaves, Euler tours, list ranking.

* Peeling m layers of leaves leaves exactly the image of the m-fold parent map, so doubling that map
  peels 1, 2, 4, ... layers. When a round peels nothing any more only loops are left.
* Each tree's Euler tour is a linked list of two arcs a node. Lists are ranked by splicing out a
  random independent set of arcs until at most ``local_max`` are left, ranking those in one task by
  pointer jumping, and putting the spliced arcs back in reverse order.
* The ranks give entry and exit numbers: depth is the surplus of downward arcs, u is an ancestor of
  v iff u's interval holds v's, and the number of descendants is half the interval. Paths are read
  off in order of entry, in chunks of the tour; each chunk gets the ancestors whose intervals reach
  into it, so a tree with a third of all nodes is no single task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.functions.text import strip
from tripleloom.operators.ordered import sequence
from tripleloom.session import materialise

#: Arcs that one task ranks at most, after splicing; the result does not depend on it.
LOCAL_ARCS = 1 << 14
#: Tour positions of one chunk of path building.
CHUNK = 1 << 14


def list_rank(arcs: DataFrame, local_max: int = LOCAL_ARCS) -> DataFrame:
    """Rank of linked lists: ``arcs`` (id, next or null, w) -> (id, tail, after, total).

    ``after`` is the number of arcs behind the arc in its list, ``total`` the sum of w from the arc
    to the end, ``tail`` the list's last arc. Every id occurs once and is next of one arc at most.
    A list that has shrunk to one arc is ranked as it stands; only longer ones count for ``local_max``,
    so any number of lists comes to an end.
    """
    one = F.lit(1).cast("long")
    live = materialise(
        arcs.select("id", "next", one.alias("c"), F.col("w").cast("long").alias("w"), F.when(F.col("next").isNull(), F.col("id")).alias("tail")), "arcs",
    )
    spliced: list[DataFrame] = []
    while live.filter("next is not null").count() > local_max:
        coin = F.xxhash64(F.lit(len(spliced)), "id").bitwiseAND(F.lit(1))
        tossed = live.withColumn("coin", coin)
        out = tossed.filter("coin = 1").select(*[F.col(c).alias(f"x_{c}") for c in ("id", "next", "c", "w", "tail")])
        joined = materialise(tossed.filter("coin = 0").join(out, F.col("next") == F.col("x_id"), "left"), "spliced")
        took = F.col("x_id").isNotNull()
        gone = joined.filter(took).select(*[F.col(f"x_{c}").alias(c) for c in ("id", "next", "c", "w", "tail")])
        kept = joined.select(
            "id", F.when(took, F.col("x_next")).otherwise(F.col("next")).alias("next"), (F.col("c") + F.coalesce("x_c", F.lit(0))).alias("c"),
            (F.col("w") + F.coalesce("x_w", F.lit(0))).alias("w"), F.when(took, F.col("x_tail")).otherwise(F.col("tail")).alias("tail"),
        )
        stay = tossed.filter("coin = 1").drop("coin").join(gone.select("id"), "id", "left_anti")
        spliced.append(gone)
        live = materialise(kept.union(stay.select("id", "next", "c", "w", "tail")), "arcs")

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [f for f in frames if len(f)]
        if not parts:
            return
        t = pd.concat(parts, ignore_index=True)
        ids, nxt = t["id"].to_numpy(np.int64), t["next"]
        order = np.argsort(ids)
        has = nxt.notna().to_numpy()
        j = np.arange(len(t))
        j[has] = order[np.searchsorted(ids[order], nxt[has].to_numpy(np.int64))]
        c, w = t["c"].to_numpy(np.int64).copy(), t["w"].to_numpy(np.int64).copy()
        extra_c, extra_w = np.where(has, 0, c - 1), np.where(has, 0, w)  # arcs behind: the tail itself does not count
        c[~has] = w[~has] = 0  # the tail adds nothing while pointers jump, its own share comes last
        while True:
            k = j[j]
            if (k == j).all():
                break
            c, w = c + c[j], w + w[j]
            j = k
        tails = np.where(has, 0, t["tail"].fillna(0).to_numpy(np.int64))
        yield pd.DataFrame({"id": ids, "tail": tails[j], "after": c + extra_c[j], "total": w + extra_w[j]})

    ends, longer = live.filter("next is null"), live.filter("next is not null")
    met = longer.select(F.col("next").alias("id"))
    few = longer.union(ends.join(met, "id", "left_semi").select(*longer.columns))  # at most 2 local_max rows
    done = few.coalesce(1).mapInPandas(local, "id long, tail long, after long, total long")
    done = done.union(ends.join(met, "id", "left_anti").select("id", "tail", (F.col("c") - 1).alias("after"), F.col("w").alias("total")))
    if spliced:
        done = materialise(done, "ranked")
    for gone in reversed(spliced):
        behind = done.select(F.col("id").alias("next"), F.col("tail").alias("t_tail"), F.col("after").alias("a"), F.col("total").alias("t"))
        back = gone.join(behind, "next", "left").select(
            "id",
            F.coalesce("t_tail", "tail").alias("tail"),
            F.when(F.col("next").isNull(), F.col("c") - 1).otherwise(F.col("a") + F.col("c")).alias("after"),
            F.when(F.col("next").isNull(), F.col("w")).otherwise(F.col("w") + F.col("t")).alias("total"),
        )
        done = materialise(done.union(back), "ranked")
    return done


def find_loops(nodes: DataFrame) -> DataFrame | None:
    """(nid, loop): every node that is on a loop or below one, with the smallest nid on the loop."""
    jump = materialise(nodes.filter("parent is not null").select("nid", F.col("parent").alias("j")), "peeled")
    left = jump.select("j").distinct().count()
    while left:
        far = jump.select(F.col("nid").alias("j"), F.col("j").alias("k"))
        jump = materialise(jump.join(far, "j").select("nid", F.col("k").alias("j")), "peeled")
        before, left = left, jump.select("j").distinct().count()
        if left == before:
            break
    if not left:
        return None
    on_loop = jump.select(F.col("j").alias("nid")).distinct()
    ring = materialise(on_loop.join(nodes, "nid").select("nid", F.col("parent").alias("j"), F.least("nid", "parent").alias("m")), "loop")
    while True:  # the minimum over 2, 4, 8, ... steps along the loop
        far = ring.select(F.col("nid").alias("j"), F.col("j").alias("j2"), F.col("m").alias("m2"))
        ring = materialise(
            ring.join(far, "j").select("nid", F.col("j2").alias("j"), F.least("m", "m2").alias("m"), (F.col("m2") < F.col("m")).alias("changed")), "loop",
        )
        if not ring.filter("changed").head(1):
            break
        ring = ring.drop("changed")
    return materialise(jump.join(ring.select(F.col("nid").alias("j"), F.col("m").alias("loop")), "j").select("nid", "loop"), "loops")


def _paths(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (root, chunk, entry), a chunk's outer ancestors first: paths by a stack."""
    at, stack = None, []
    for f in frames:
        nids, paths = [], []
        for nid, root, chunk, depth, own, name in zip(f["nid"], f["root"], f["chunk"], f["depth"], f["own"], f["id"], strict=True):
            if (root, chunk) != at:
                at, stack = (root, chunk), []
            del stack[depth:]
            stack.append(name)
            if own:
                nids.append(nid)
                paths.append("/".join(stack))
        yield pd.DataFrame({"nid": pd.Series(nids, dtype="int64"), "path": pd.Series(paths, dtype=object)})


def hierarchy(links: DataFrame, node: str, parent: str, version: str, local_max: int = LOCAL_ARCS, chunk: int = CHUNK) -> DataFrame:
    """id, root_id, depth, path, entry, exit, descendants: one row for each id of ``node``.

    Of an id's rows the one with the latest ``version`` holds (null earliest; of ties the one with
    the largest parent text). Null ids are left out; a parent is read without outer white space and
    is none if null, empty or unknown. On a loop or below one: root_id is the loop's smallest id,
    depth -1, path '', the rest null. u is an ancestor of v iff both have one root_id and
    u.entry < v.entry <= v.exit < u.exit. Other columns do not matter; an empty table gives no row.
    """
    held = (
        links.filter(F.col(node).isNotNull())
        .select(F.col(node).alias("id"), strip(F.col(parent)).alias("p"), F.col(version).alias("v"))
        .groupBy("id")
        .agg(F.max(F.struct("v", "p")).alias("r"))
    )
    # dense numbers in the order of code points, so the smallest number is the smallest id
    numbered = materialise(sequence(held.select("id", F.col("r.p").alias("p")), [], ["id"], "id", "ids").select(F.col("pos").alias("nid"), "id", "p"), "nodes")
    known = numbered.select(F.col("id").alias("p"), F.col("nid").alias("parent"))
    nodes = materialise(numbered.join(known, "p", "left").select("nid", "id", "parent"), "parents")
    loops = find_loops(nodes)
    trees = nodes if loops is None else materialise(nodes.join(loops, "nid", "left_anti"), "trees")
    # next sibling of each child, first child of each parent
    kids = sequence(trees.filter("parent is not null").select("parent", "nid"), ["parent"], ["nid"], "nid", "siblings")
    first = trees.filter("parent is not null").groupBy("parent").agg(F.min("nid").alias("child"))
    t = (
        trees.select("nid", "parent")
        .join(first.select(F.col("parent").alias("nid"), "child"), "nid", "left")
        .join(kids.select("nid", F.col("next_nid").alias("sibling")), "nid", "left")
    )
    down, up = F.col("nid") * 2, F.col("nid") * 2 + 1
    arcs = t.select(
        F.explode(
            F.array(
                F.struct(down.alias("id"), F.coalesce(F.col("child") * 2, up).alias("next"), F.lit(1).alias("w")),
                F.struct(up.alias("id"), F.coalesce(F.col("sibling") * 2, F.col("parent") * 2 + 1).alias("next"), F.lit(-1).alias("w")),
            )
        ).alias("a")
    ).select("a.*")
    ranked = materialise(list_rank(arcs, local_max), "tour")
    half = ranked.select(
        F.floor(F.col("id") / 2).cast("long").alias("nid"), (F.col("id") % 2).alias("side"), F.floor(F.col("tail") / 2).cast("long").alias("root"), "after",
        "total",
    )
    per = (
        half.groupBy("nid")
        .agg(F.max("root").alias("root"), F.max(F.when(F.col("side") == 0, F.col("after"))).alias("a_in"), F.max(F.when(F.col("side") == 1, F.col("after"))).alias("a_out"), F.max(F.when(F.col("side") == 0, F.col("total"))).alias("s"))
    )
    length = per.filter("nid = root").select("root", (F.col("a_in") + 1).alias("n"))
    tour = materialise(
        per.join(length, "root").join(trees.select("nid", "id"), "nid").select("nid", "id", "root", (F.col("n") - 1 - F.col("a_in")).alias("entry"), (F.col("n") - 1 - F.col("a_out")).alias("exit"), (-F.col("s")).cast("int").alias("depth")),
        "intervals",
    )
    c_in, c_out = F.floor(F.col("entry") / chunk), F.floor(F.col("exit") / chunk)
    rows = (
        tour.select("nid", "root", "id", "entry", "depth", F.explode(F.sequence(c_in, c_out)).alias("chunk"), c_in.alias("c0"))
        .withColumn("own", F.col("chunk") == F.col("c0"))
    )
    paths = (
        rows.drop("c0")
        .repartition("root", "chunk")
        .sortWithinPartitions("root", "chunk", "entry")
        .select("nid", "root", "chunk", "depth", "own", "id")
        .mapInPandas(_paths, "nid long, path string")
    )
    root_names = numbered.select(F.col("nid").alias("root"), F.col("id").alias("root_id"))
    out = (
        tour.join(paths, "nid")
        .join(root_names, "root")
        .select("id", "root_id", "depth", "path", "entry", "exit", ((F.col("exit") - F.col("entry") - 1) / 2).cast("long").alias("descendants"))
    )
    if loops is not None:
        none = F.lit(None).cast("long")
        looped = loops.join(numbered.select("nid", "id"), "nid").join(root_names.withColumnRenamed("root", "loop"), "loop")
        out = out.union(looped.select("id", "root_id", F.lit(-1).alias("depth"), F.lit("").alias("path"), none, none, none))
    return out


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance): all pairs, from ``hierarchy``'s paths, whose total length they are."""
    t = tree.filter("depth > 0").select("id", "root_id", "depth", "entry")
    up = (
        tree.filter("depth >= 0")
        .select(F.col("id").alias("ancestor"), "root_id", F.col("depth").alias("d"), F.col("entry").alias("lo"), F.col("exit").alias("hi"))
    )
    # meet in blocks of the tour: an ancestor's interval is listed once for each block it reaches into
    block = F.floor(F.col("entry") / CHUNK)
    up = up.filter("hi > lo + 1").withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / CHUNK), F.floor(F.col("hi") / CHUNK))))
    return (
        t.withColumn("block", block)
        .join(up, ["root_id", "block"])
        .filter("lo < entry and entry < hi")
        .select("ancestor", F.col("id").alias("descendant"), (F.col("depth") - F.col("d")).alias("distance"))
    )


def hierarchy_found(communities: DataFrame, **kw) -> DataFrame:
    return (
        hierarchy(communities, "community_id", "parent_community_id", "created_at", **kw)
        .select(F.col("id").alias("community_id"), "root_id", F.col("depth").cast("int").alias("depth"), "path")
    )
