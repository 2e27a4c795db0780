"""Duplicates hidden by formatting differences (problem 4) and the best record of each group (problem 5).

Copies, method: canonical records are range-partitioned and sorted by (hash, key, row), Spark's
sort spilling to disk as needed; neighbouring rows are compared by their full keys, a run of equal
keys is one record, and runs that cross partition borders are joined by two rows a partition.
The row number is part of the range key, so a record with a third of all rows spreads over
partitions instead of landing in one.

Best record, method: consistent bundles. Fields that depend on each other form a bundle that is
taken whole from one row; branch and bound looks for the donors of least total rank under
functional dependencies. Every group enters the search with its root node, whose bound is every
bundle's own best row, one map-side aggregation; where it meets all dependencies the search ends
there, as nothing can be better. The other groups are branched, over their best distinct bundle values.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from tripleloom.functions.text import iso_micros, letters_digits, strip
from tripleloom.operators.history import ATTRIBUTES
from tripleloom.operators.ordered import sort_globally
from tripleloom.session import materialise

#: Predicates (by letters and digits) whose subject and object may be exchanged.
SYMMETRIC = ["similarto", "sameas"]
LAYERS = ["source_facts", "normalised_triples", "inferred_relations", "llm_hypotheses"]
METHODS = ["structural", "rule", "llm"]
NO_VALUE = ["", "n/a", "unknown", "none", "-"]


def canonical_key(subject: Column, predicate: Column, object_: Column) -> Column:
    """One text that two rows share iff they state the same fact; null fields equal null fields only."""
    p = letters_digits(predicate)
    o = (
        F.when(
            object_.contains("|"),
            F.concat(F.lit("|"), F.array_join(F.array_sort(F.filter(F.transform(F.split(object_, r"\|"), letters_digits), lambda x: x != "")), "|")),
        )
        .otherwise(letters_digits(object_))
    )
    s = letters_digits(subject)
    none = F.lit("\x00")
    s, p, o = F.coalesce(s, none), F.coalesce(p, none), F.coalesce(o, none)
    swap = p.isin(SYMMETRIC) & (s > o)
    return F.concat(p, F.lit("\x1f"), F.when(swap, o).otherwise(s), F.lit("\x1f"), F.when(swap, s).otherwise(o))


def adjacent_runs(records: DataFrame, key: str, row: str) -> DataFrame:
    """(row, first): each row with the smallest row of its run of equal keys.

    ``row`` is bigint; rows with one number and key are kept as often as they come.
    """
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("first", T.LongType()), T.StructField("pid", T.IntegerType()), T.StructField("run", T.LongType()), T.StructField("edge", T.StringType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, run, last_key, first, pending = TaskContext.get().partitionId(), -1, None, None, None
        for b in batches:
            m = b.num_rows
            if not m:
                continue
            keys, rows = b.column(1), b.column(2)
            fresh = pc.not_equal(keys.slice(1), keys.slice(0, m - 1)).to_numpy(zero_copy_only=False) if m > 1 else np.zeros(0, bool)
            opens = np.concatenate([[last_key is None or keys[0].as_py() != last_key], fresh])
            number = rows.to_numpy()
            runs = run + np.cumsum(opens)
            at = np.maximum.accumulate(np.where(opens, np.arange(m), -1))  # where each row's run begins; -1 in an earlier batch
            firsts = np.where(at >= 0, number[at], 0 if first is None else first)
            run, first = int(runs[-1]), int(firsts[-1])
            edge = [None] * m
            if pending is None:
                edge[0] = keys[0].as_py()  # the partition's first key
            else:
                yield pending
            last_key = keys[m - 1].as_py()
            pending = pa.RecordBatch.from_arrays(
                [rows, pa.array(firsts, pa.int64()), pa.array([pid] * m, pa.int32()), pa.array(runs, pa.int64()), pa.array(edge, pa.string())],
                names=schema.names,
            )
        if pending is not None:
            yield pending
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([first], pa.int64()), pa.array([pid], pa.int32()), pa.array([run], pa.int64()), pa.array([last_key], pa.string())], names=schema.names)

    keyed = records.select(F.xxhash64(key).alias("h"), F.col(key).alias("key"), F.col(row).cast("long").alias("row"))
    runs = materialise(sort_globally(keyed, ["h", "key", "row"]).mapInArrow(scan, schema), "runs")
    ends = (  # two rows a partition
        runs.filter("edge is not null")
        .select("pid", F.col("row").isNull().alias("is_last"), "first", "run", F.sha2("edge", 256).alias("k"))
        .collect()
    )
    heads, tails = {e["pid"]: e for e in ends if not e["is_last"]}, {e["pid"]: e for e in ends if e["is_last"]}
    carry: list[tuple[int, int]] = []
    open_key, open_first = None, None
    for p in sorted(heads):
        goes_on = open_key == heads[p]["k"]
        if goes_on:
            carry.append((p, open_first))
        if not (goes_on and tails[p]["run"] == 0):
            open_first = tails[p]["first"]
        open_key = tails[p]["k"]
    rows = runs.filter("row is not null").select("row", "first", "pid", "run")
    if not carry:
        return rows.select("row", "first")
    small = records.sparkSession.createDataFrame(carry, "pid int, carried long")  # a row a partition at most
    return (
        rows.join(F.broadcast(small), "pid", "left")
        .select("row", F.when(F.col("run") == 0, F.coalesce("carried", "first")).otherwise(F.col("first")).alias("first"))
    )


def fact_runs(triples: DataFrame) -> DataFrame:
    """(row, first) over the triples without the attribute reports; rows without row_id are left out."""
    facts = triples.filter(F.col("row_id").isNotNull() & ~F.coalesce(F.col("predicate").isin(ATTRIBUTES), F.lit(False)))
    return adjacent_runs(facts.select("row_id", canonical_key(F.col("subject"), F.col("predicate"), F.col("object")).alias("key")), "key", "row_id")


def fact_copies(triples: DataFrame) -> DataFrame:
    """(first_row_id, row_id): one row for each copy but the first. Null fields equal null fields."""
    return fact_runs(triples).filter("row <> first").select(F.col("first").alias("first_row_id"), F.col("row").alias("row_id"))


def collapse(triples: DataFrame) -> DataFrame:
    """(first_row_id, n_copies): every fact once with the number of its rows."""
    return fact_runs(triples).groupBy(F.col("first").alias("first_row_id")).agg(F.count(F.lit(1)).alias("n_copies"))


# --- best record -------------------------------------------------------------------------------


def trust_rank(row: str = "row_id") -> Column:
    """Rank of a triple, least is best: layer, method, highest confidence, latest timestamp, smallest row."""
    layer = F.array_position(F.array(*map(F.lit, LAYERS)), F.lower(strip(F.col("layer"))))
    method = F.array_position(F.array(*map(F.lit, METHODS)), F.lower(strip(F.col("extraction_method"))))
    worst = F.lit(99).cast("long")
    return F.struct(
        F.when(layer > 0, layer).otherwise(worst).alias("layer"),
        F.when(method > 0, method).otherwise(worst).alias("method"),
        F.coalesce(-F.when(~F.isnan("confidence"), F.col("confidence")), F.lit(float("inf"))).alias("confidence"),
        F.coalesce(-iso_micros(F.col("timestamp")), F.lit(2**63 - 1)).alias("age"),
        F.col(row).alias("row"),
    )


def has_value(c: Column) -> Column:
    return F.coalesce(~F.lower(strip(c)).isin(NO_VALUE), F.lit(False))


def best_bundles(
    rows: DataFrame, group: str, rank: Column, bundles: dict[str, Column], dependencies: list[tuple[str, str]] | None = None, first_k: int = 8,
) -> DataFrame:
    """(group, bundle, row): for each group the row that each bundle is taken from.

    ``bundles`` maps a bundle's name to the condition under which a row can give it; ``rank`` is a
    struct that ends in the row's number, least is best. A dependency (a, b) between columns x of
    ``rows``, written ("bundle.column", "bundle.column"), demands that groups agreeing in the first
    agree in the second; here: the chosen values of both must occur together in some row of the group.
    Bundles that no row can give have no row. Without dependencies, and wherever each bundle's best
    row meets them, the root node's bound is the answer. Else branch and bound runs over the best
    ``first_k`` distinct values of each bundle; if the optimum found is no better than the bound of
    the values beyond them, the group is tried again with twice as many.
    """
    deps = [tuple(tuple(x.split(".", 1)) for x in d) for d in dependencies or []]
    ranked = rows.withColumn("_rank", rank)
    best = ranked.groupBy(group).agg(*[F.min(F.when(ok, F.col("_rank"))).alias(name) for name, ok in bundles.items()])
    root = (
        best.select(group, F.explode(F.array(*[F.struct(F.lit(n).alias("bundle"), F.col(n)["row"].alias("row")) for n in bundles])).alias("b"))
        .select(group, "b.bundle", "b.row")
        .filter("row is not null")
    )
    if not deps:
        return root
    return _branch(ranked, group, root, bundles, deps, first_k)


def _search(rows: list[tuple[str, int, int, str]], names: list[str], deps: list, k: int) -> list[tuple[str, int, bool]]:
    """Branch and bound over one group's candidate lists, best first by the places given up; of equal costs
    the earlier bundles keep the better places. ``rows`` are (bundle, place, row, values as JSON)."""
    together: list[set[tuple]] = [set() for _ in deps]
    lists: dict[str, list[tuple[int, int, dict]]] = {n: [] for n in names}
    for bundle, place, row, v in rows:
        held = json.loads(v)
        if bundle.startswith("~"):
            together[int(bundle[1:])].add((held.get("x"), held.get("y")))
        else:
            lists[bundle].append((place, row, held))
    over = any(len(x) > k for x in lists.values())
    ranked = {n: sorted(x, key=lambda c: c[0])[:k] for n, x in lists.items() if x}
    order = list(ranked)
    heap: list[tuple[int, tuple[int, ...]]] = [(0, ())]  # cost so far, choice
    while heap:
        cost, choice = heapq.heappop(heap)
        if over and cost >= k:  # a value beyond the lists might do as well
            return [("", 0, False)]
        if len(choice) == len(order):
            return [(n, ranked[n][p][1], True) for n, p in zip(order, choice, strict=True)]
        for place in range(len(ranked[order[len(choice)]])):
            now = (*choice, place)
            at = {n: ranked[n][p][2] for n, p in zip(order, now, strict=False)}
            if all(a not in at or b not in at or (at[a].get(f"v_{x}"), at[b].get(f"v_{y}")) in together[i] for i, ((a, x), (b, y)) in enumerate(deps)):
                heapq.heappush(heap, (cost + place, now))
    if over:
        return [("", 0, False)]
    return [(n, ranked[n][0][1], True) for n in order]  # no choice meets all: the best row gives every bundle it can


def _searcher(group: str, names: list[str], deps: list, k: int):
    """Rows sorted by group -> (g, bundle, row, done); a group's rows are bounded by k, its neighbours' do not matter."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, rows = None, []
        for f in frames:
            out: list[tuple] = []
            for g, *row in zip(f[group], f["bundle"], f["place"], f["row"], f["v"], strict=True):
                if rows and g != at:
                    out += [(at, *x) for x in _search(rows, names, deps, k)]
                    rows = []
                at = g
                rows.append(tuple(row))
            yield pd.DataFrame(out, columns=["g", "bundle", "row", "done"])
        if rows:
            yield pd.DataFrame([(at, *x) for x in _search(rows, names, deps, k)], columns=["g", "bundle", "row", "done"])

    return run


def _branch(ranked: DataFrame, group: str, root: DataFrame, bundles: dict[str, Column], deps: list, first_k: int) -> DataFrame:
    needed: dict[str, list[str]] = {n: [] for n in bundles}
    for (a, x), (b, y) in deps:
        needed[a].append(x)
        needed[b].append(y)
    root = materialise(root, "bounds")
    values = ranked.select(
        group, F.col("_rank.row").alias("row"), *[F.col(c).cast("string").alias(f"v_{c}") for c in sorted({c for cs in needed.values() for c in cs})],
    )
    chosen = root.join(values, [group, "row"])
    # the pairs of values that rows of the group hold together
    wrong = None
    for (a, x), (b, y) in deps:
        left = chosen.filter(F.col("bundle") == a).select(group, F.col(f"v_{x}").alias("x"))
        right = chosen.filter(F.col("bundle") == b).select(group, F.col(f"v_{y}").alias("y"))
        both = values.select(group, F.col(f"v_{x}").alias("px"), F.col(f"v_{y}").alias("py")).distinct()
        demand = left.join(right, group)
        held = (
            demand.join(
                both.withColumnRenamed(group, "_g"),
                (F.col(group) == F.col("_g")) & F.col("x").eqNullSafe(F.col("px")) & F.col("y").eqNullSafe(F.col("py")), "left_semi",
            )
            .select(group)
        )
        bad = demand.select(group).join(held, group, "left_anti")
        wrong = bad if wrong is None else wrong.union(bad)
    pending = materialise(wrong.distinct(), "conflicts")
    settled = root.join(pending, group, "left_anti")
    k = first_k
    names = list(bundles)
    group_type = dict(ranked.dtypes)[group]
    while pending.head(1):
        mine = ranked.join(pending, group)
        # candidates: the best row of each distinct bundle value, then the k best of those (and one more as bound)
        parts = []
        for n, ok in bundles.items():
            cols = sorted(set(needed[n]))
            per = mine.filter(ok).groupBy(group, *cols).agg(F.min("_rank").alias("r"))
            place = F.row_number().over(Window.partitionBy(group).orderBy("r")) - 1  # limited to k + 1 before its shuffle
            top = per.withColumn("place", place).filter(F.col("place") <= k)
            picked = F.struct(F.lit(0).alias("_"), *[F.col(c).cast("string").alias(f"v_{c}") for c in cols])
            parts.append(top.select(group, F.lit(n).alias("bundle"), "place", F.col("r.row").alias("row"), F.to_json(picked).alias("v")))
        cand = parts[0]
        for p in parts[1:]:
            cand = cand.union(p)
        pair_rows = None
        for i, ((a, x), (b, y)) in enumerate(deps):
            pairs = mine.select(group, F.col(x).cast("string").alias("x"), F.col(y).cast("string").alias("y")).distinct()
            for n, c, s in ((a, x, "x"), (b, y, "y")):  # only pairs of candidate values matter, (k + 1)^2 a group at most
                mine_only = cand.filter(F.col("bundle") == n).select(F.col(group).alias("_g"), F.get_json_object("v", f"$.v_{c}").alias("_v")).distinct()
                pairs = pairs.join(mine_only, (F.col(group) == F.col("_g")) & F.col(s).eqNullSafe(F.col("_v")), "left_semi")
            one = pairs.select(
                group, F.lit(f"~{i}").alias("bundle"), F.lit(0).alias("place"), F.lit(0).cast("long").alias("row"),
                F.to_json(F.struct("x", "y")).alias("v"),
            )
            pair_rows = one if pair_rows is None else pair_rows.union(one)

        sorted_ = cand.union(pair_rows).repartition(group).sortWithinPartitions(group)
        tried = materialise(sorted_.mapInPandas(_searcher(group, names, deps, k), f"g {group_type}, bundle string, row long, done boolean"), "branched")
        settled = settled.union(tried.filter("done").select(F.col("g").alias(group), "bundle", "row"))
        pending = materialise(tried.filter("not done").select(F.col("g").alias(group)).distinct(), "conflicts")
        k *= 2
    return settled


def _grouped(triples: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of facts with several rows: first, rank, and ``columns`` (a list of (name, Column))."""
    groups = materialise(fact_runs(triples), "groups")
    copies_ = groups.filter("row <> first")
    several = copies_.select("first").distinct().select("first", F.col("first").alias("row")).union(copies_.select("first", "row"))
    slim = triples.select(F.col("row_id").alias("_row"), trust_rank().alias("rank"), *columns)
    return several.join(slim, several["row"] == slim["_row"]).drop("row", "_row")


def survivors(triples: DataFrame) -> DataFrame:
    """(first_row_id, field_name, row_id) of each fact with several rows: the record to keep, and the
    row that gives evidence, source and object_datatype, each a bundle of its own.

    Unknown layers and methods rank behind the known ones, null confidence and unreadable times last.
    """
    fields = ["evidence", "source", "object_datatype"]
    rows = _grouped(triples, [has_value(F.col(c)).alias(c) for c in fields])
    chosen = best_bundles(rows, "first", F.col("rank"), {"record": F.lit(True), **{c: F.col(c) for c in fields}})
    return chosen.select(F.col("first").alias("first_row_id"), F.col("bundle").alias("field_name"), F.col("row").alias("row_id"))


#: Bundles of a triple: what belongs together and is taken from one row, and which column must hold a value.
BUNDLES = {"origin": ("source", ["source", "source_doc"]), "quote": ("evidence", ["evidence"]), "process": ("extraction_method", ["adapter", "extraction_method"]), "typing": ("object_datatype", ["object_is_literal", "object_datatype"])}
#: What depends on what: the quote stands in the document of origin, the process is one of the source.
DEPENDENCIES = [("origin.source_doc", "quote.evidence"), ("origin.source", "process.adapter")]


def consistent_survivors(triples: DataFrame) -> DataFrame:
    """(first_row_id, bundle, row_id) of each fact with several rows: whole bundles, ranked as in
    ``survivors``, such that the chosen document and quote, and the chosen source and adapter, occur
    together in a row of the fact. Of equal choices the earlier bundle keeps the better row; where no
    choice meets the dependencies every bundle has its own best row. Bundles without a value have no row.
    """
    columns = sorted({c for _, cs in BUNDLES.values() for c in cs})
    rows = _grouped(triples, [F.col(c) for c in columns])
    chosen = best_bundles(rows, "first", F.col("rank"), {n: has_value(F.col(c)) for n, (c, _) in BUNDLES.items()}, DEPENDENCIES)
    return chosen.select(F.col("first").alias("first_row_id"), "bundle", F.col("row").alias("row_id"))
