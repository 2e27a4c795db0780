"""Global order without a single hot task.

A Window partitioned by a key puts all rows of that key into one task. ``sequence`` instead
range-partitions and sorts by (key, order), so a hot key spreads over several partitions, reads
each partition once, and stitches neighbours over partition borders with two rows a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripleloom.session import materialise, shuffle_partitions


def sort_globally(df: DataFrame, by: list[str], n: int | None = None) -> DataFrame:
    """Rows range-partitioned and sorted by ``by``; partition numbers follow the order."""
    return df.repartitionByRange(n or shuffle_partitions(df.sparkSession), *by).sortWithinPartitions(*by)


def _same(a: pa.Array, b: pa.Array) -> pa.Array:
    both_null = pc.and_(pc.is_null(a), pc.is_null(b))
    return pc.or_(both_null, pc.fill_null(pc.equal(a, b), False))


def sequence(df: DataFrame, key: list[str], order: list[str], following: str, label: str = "sequence", n: int | None = None) -> DataFrame:
    """Every row with ``pos``, its dense number (from 0) in the order of key and order, and
    ``next_<following>``: that column of the next row if it has the same key, else null.

    Nulls sort first and equal each other. An empty table stays empty. The result is a written table.
    """
    schema = T.StructType(df.schema.fields + [T.StructField(f"next_{following}", df.schema[following].dataType), T.StructField("_pid", T.IntegerType()), T.StructField("_idx", T.LongType()), T.StructField("_last", T.BooleanType())])
    names = schema.names

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, idx, held = TaskContext.get().partitionId(), 0, None

        def emit(t: pa.Table, nxt: pa.Array, last: bool) -> pa.RecordBatch:
            nonlocal idx
            m = t.num_rows
            ids = pa.array(np.arange(idx, idx + m))
            ends = pa.array([False] * (m - 1) + [last], pa.bool_()) if m else pa.array([], pa.bool_())
            idx += m
            out = pa.Table.from_arrays([*t.columns, nxt, pa.array([pid] * m, pa.int32()), ids, ends], names=names)
            return out.combine_chunks().to_batches()[0]

        for b in batches:
            if b.num_rows == 0:
                continue
            t = pa.Table.from_batches([b])
            if held is not None:
                t = pa.concat_tables([held, t]).combine_chunks()
            m = t.num_rows
            if m > 1:
                same = None
                for k in key:
                    col = t.column(k).combine_chunks()
                    s = _same(col.slice(0, m - 1), col.slice(1))
                    same = s if same is None else pc.and_(same, s)
                nxt = t.column(following).combine_chunks().slice(1)
                if same is not None:
                    # a missing index takes null; choosing between a slice and null breaks offsets of texts
                    nxt = nxt.take(pa.array(np.arange(m - 1), mask=~same.to_numpy(zero_copy_only=False)))
                yield emit(t.slice(0, m - 1), nxt, False)
            held = t.slice(m - 1)
        if held is not None:
            yield emit(held, pa.nulls(1, held.column(following).type), True)

    rows = materialise(sort_globally(df, key + order, n).mapInArrow(scan, schema), label)
    digest = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in key]), 256) if key else F.lit("")
    ends = (  # two rows a partition
        rows.filter((F.col("_idx") == 0) | F.col("_last"))
        .select("_pid", "_idx", "_last", digest.alias("k"), F.col(following).alias("v"))
        .collect()
    )
    firsts, lasts = {r["_pid"]: r for r in ends if r["_idx"] == 0}, {r["_pid"]: r for r in ends if r["_last"]}
    offsets, total, pids = [], 0, sorted(firsts)
    for i, p in enumerate(pids):
        after = firsts[pids[i + 1]] if i + 1 < len(pids) else None
        offsets.append((p, total, after["v"] if after is not None and after["k"] == lasts[p]["k"] else None))
        total += lasts[p]["_idx"] + 1
    small = df.sparkSession.createDataFrame(
        offsets,
        T.StructType([T.StructField("_pid", T.IntegerType()), T.StructField("_offset", T.LongType()), T.StructField("_after", df.schema[following].dataType)]),
    )
    return (
        rows.join(F.broadcast(small), "_pid")
        .withColumn(f"next_{following}", F.when(F.col("_last"), F.col("_after")).otherwise(F.col(f"next_{following}")))
        .withColumn("pos", F.col("_idx") + F.col("_offset"))
        .drop("_pid", "_idx", "_last", "_offset", "_after")
    )
