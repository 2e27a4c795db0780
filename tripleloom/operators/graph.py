"""Graph traversal over triples: neighbourhoods, expansion, shortest paths, connected components.

``subject = n OR object = n`` is never joined as such (that is a nested loop); every traversal uses
the symmetric edge table, where it is an equi-join, and cuts lineage once a hop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripleloom.schema import TRUSTED
from tripleloom.session import discard, materialise

#: Links that one task joins to components; distributed rounds go on until no more are left.
LOCAL_LINKS = 1_000_000


def symmetric(triples: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(node, other, *keep): each triple seen from both ends, a loop once."""
    keep = keep or []
    return (
        triples.select(
            F.explode(F.array_distinct(F.array(F.struct(F.col("subject").alias("node"), F.col("object").alias("other")), F.struct(F.col("object").alias("node"), F.col("subject").alias("other"))))).alias("e"),
            *keep,
        )
        .select("e.node", "e.other", *keep)
    )


def hop_distances(triples: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node, depth): every node within ``depth`` hops of a node of ``start`` (id), with its distance."""
    edges = materialise(symmetric(triples).filter("node <> other").distinct(), "arcs")  # written once, read every hop
    seen = materialise(start.select(F.col("id").alias("node"), F.lit(0).alias("depth")).distinct(), "hops")
    for d in range(depth):
        front = seen.filter(F.col("depth") == d).select("node")
        fresh = edges.join(front, "node", "left_semi").select(F.col("other").alias("node")).distinct().join(seen, "node", "left_anti")
        fresh = materialise(fresh.withColumn("depth", F.lit(d + 1)), "hops")
        if not fresh.head(1):
            break
        seen = seen.union(fresh)
    return seen


def touching(triples: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct triples with an end in ``nodes`` (node): two equi-joins, no OR."""
    n = nodes.select("node").distinct()
    ids = (
        triples.join(n, triples["subject"] == n["node"], "left_semi")
        .select("row_id")
        .union(triples.join(n, triples["object"] == n["node"], "left_semi").select("row_id"))
        .distinct()
    )
    return triples.join(ids, "row_id", "left_semi")


def neighbourhood(triples: DataFrame, start: DataFrame, max_depth: int = 2, layer: str | None = None) -> DataFrame:
    """Triples that touch a node within ``max_depth`` hops (so edges reach one hop further)."""
    t = triples.filter(F.col("layer") == layer) if layer else triples
    return touching(t, hop_distances(t, start, max_depth))


def expand(triples: DataFrame, start: DataFrame, hops: int, layers: list[str] = TRUSTED) -> DataFrame:
    """Uncapped expansion over trusted layers: triples of all nodes within ``hops``."""
    t = triples.filter(F.col("layer").isin(layers))
    return touching(t, hop_distances(t, start, hops))


def expand_capped(triples: DataFrame, anchors: list[str], hops: int = 2, per_node: int = 50, stop: int = 500, layers: list[str] = TRUSTED) -> list[dict]:
    """The evidence subgraph for a question: breadth first, ``per_node`` triples a node by triple_id,
    no further node once ``stop`` triples are held. The caps are the feature: they bound the result to
    stop + per_node rows, as a prompt must be, and what comes to the driver at once to (stop + per_node) * per_node.
    """
    from itertools import islice

    spark = triples.sparkSession
    cols = ["triple_id", "subject", "predicate", "object", "source_kind", "target_kind", "confidence", "evidence", "source_doc"]
    t = triples.filter(F.col("layer").isin(layers))
    queue, visited = [(a, 0) for a in dict.fromkeys(anchors)], set(anchors)
    out: dict[str, dict] = {}
    while queue and len(out) < stop:
        # nodes beyond stop / 1 cannot be reached before the stop unless they bring nothing new
        batch = list(islice(queue, stop + per_node))
        queue = queue[len(batch) :]
        nodes = F.broadcast(spark.createDataFrame([(n,) for n, _ in batch], "node string"))  # bounded by the caps
        rows = symmetric(t, cols).join(nodes, "node")
        w = Window.partitionBy("node").orderBy("triple_id")
        picked = rows.dropDuplicates(["node", "triple_id"]).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= per_node).orderBy("node", "rn")
        by: dict[str, list[dict]] = {}
        for r in picked.collect():  # at most (stop + per_node) * per_node rows
            by.setdefault(r["node"], []).append({c: r[c] for c in cols})
        for n, d in batch:
            if len(out) >= stop:
                break
            for row in by.get(n, []):
                if row["triple_id"] in out:
                    continue
                out[row["triple_id"]] = row
                if d < hops:
                    for other in (row["subject"], row["object"]):
                        if other not in visited:
                            visited.add(other)
                            queue.append((other, d + 1))
    return list(out.values())


def shortest_path(triples: DataFrame, a: str, b: str, max_depth: int = 4) -> list[dict] | None:
    """Edges of a shortest undirected path, [] if a = b, None if there is none within ``max_depth``.

    Of several, each node is reached from its least (previous node, subject, predicate, object).
    """
    if a == b:
        return []
    spark = triples.sparkSession
    edges = symmetric(triples, ["subject", "predicate", "object"]).filter("node <> other")
    seen = materialise(
        spark.createDataFrame([(a, 0, None)], "node string, depth int, via struct<prev:string,subject:string,predicate:string,object:string>"), "path",
    )
    for d in range(max_depth):
        front = seen.filter(F.col("depth") == d).select("node")
        step = (
            edges.join(front, "node")
            .select(F.col("other").alias("to"), F.struct(F.col("node").alias("prev"), "subject", "predicate", "object").alias("via"))
        )
        fresh = (
            step.groupBy("to")
            .agg(F.min("via").alias("via"))
            .select(F.col("to").alias("node"), F.lit(d + 1).alias("depth"), "via")
            .join(seen, "node", "left_anti")
        )
        fresh = materialise(fresh, "path")
        seen = seen.union(fresh)
        if fresh.filter(F.col("node") == b).head(1):
            path, at = [], b
            while at != a:  # one look-up a step, max_depth at most
                v = seen.filter(F.col("node") == at).first()["via"]
                path.append({"subject": v["subject"], "predicate": v["predicate"], "object": v["object"]})
                at = v["prev"]
            return path[::-1]
        if not fresh.head(1):
            return None
    return None


def spanning_links(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Places of the links among ``n`` vertices, the best of which come first, that join what all of them join: a link is left
    out only where better ones join its ends, so that the best of each vertex stays."""
    root, live, kept = np.arange(n), np.arange(len(left)), [np.zeros(0, np.int64)]
    while True:  # each group takes its best link to another
        x, y = root[left[live]], root[right[live]]
        apart = x != y
        live, x, y = live[apart], x[apart], y[apart]
        if not len(live):
            return np.sort(np.concatenate(kept))
        best = np.full(n, len(left))
        np.minimum.at(best, x, live)
        np.minimum.at(best, y, live)
        group = np.flatnonzero(best < len(left))
        link = best[group]
        kept.append(np.unique(link))
        to = np.arange(n)
        to[group] = root[left[link]] + root[right[link]] - group
        both = group[(to[to[group]] == group) & (group < to[group])]
        to[both] = both
        while (to[to] != to).any():
            to = to[to]
        root = to[root]


def _roots(edges: DataFrame) -> DataFrame:
    """(u, v): the links of all vertices of ``edges`` to their roots, found in one task."""

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if not batches:
            return
        t = pa.Table.from_batches(batches)
        both = pa.concat_arrays([t.column(c).combine_chunks() for c in ("u", "v")])
        code = both.field("id").dictionary_encode().indices.to_numpy()
        vertices = both.take(pa.array(np.unique(code, return_index=True)[1]))
        order = pc.sort_indices(pa.table(vertices.flatten(), names=[f.name for f in both.type]), [(f.name, "ascending") for f in both.type])
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        u, v = np.split(rank[code], 2)
        root = np.arange(len(order))
        while True:  # of two groups that touch, the one with the greater root joins the other
            x, y = root[u], root[v]
            if (x == y).all():
                break
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
        ends = np.flatnonzero(root != np.arange(len(order)))
        vertices = vertices.take(order)
        yield from pa.table({"u": vertices.take(pa.array(ends)), "v": vertices.take(pa.array(root[ends]))}).to_batches()

    edges = edges.select("u", "v")
    return edges.repartition(1).mapInArrow(roots, edges.schema)


def components(pairs: DataFrame, a: str = "a", b: str = "b", least=None) -> DataFrame:
    """(id, root): connected components; the root is the member that is least by ``least`` (default: the id).

    Alternating large-star and small-star rounds: a vertex's links go to its least neighbour, so hubs
    lose their edges round by round, and each round is two aggregations and a join. ``LOCAL_LINKS`` are joined in one task.
    """
    rank = least or (lambda c: F.struct(c.alias("id")))
    e = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(rank(F.col(a)).alias("u"), rank(F.col(b)).alias("v"))
    alone = e.select("u").union(e.select("v")).distinct()
    edges = materialise(e.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        if edges.count() <= LOCAL_LINKS:
            after = materialise(_roots(edges), "edges")
            discard(edges)
            edges = after
            break
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # a link moves from its lower end to that end's least neighbour
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"), (F.col("m") != F.col("u")).alias("moved"))
        large = materialise(large.groupBy("u", "v").agg(F.max("moved").alias("moved")), "large")
        low2 = large.groupBy("u").agg(F.min("v").alias("m"), (F.count(F.lit(1)) > 1).alias("several"))
        ends = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))
        small = (
            large.join(low2, "u")
            .select(F.explode(ends).alias("e"), (F.col("moved") | F.col("several")).alias("moved"))
            .select("e.u", "e.v", "moved")
            .filter("u <> v")
        )
        after = materialise(small.groupBy("u", "v").agg(F.max("moved").alias("moved")), "edges")
        discard(edges, large)
        edges = after
        if not edges.filter("moved").head(1):  # every link is one of a vertex to its root
            break
    return (
        alone.join(edges.select("u", F.col("v").alias("r")), "u", "left")
        .select(F.col("u.id").alias("id"), F.coalesce(F.col("r.id"), F.col("u.id")).alias("root"))
    )


def shortest_first(c):
    """Rank of ids for canonical names: shorter first, then by code points."""
    return F.struct(F.length(c).alias("n"), c.alias("id"))
