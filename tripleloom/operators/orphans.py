"""References to records that do not exist, per table, column and month (problem 6).

Method: compressed runs of sorted integer keys. References (already distinct per column, month and
key) and parent keys are range-partitioned by key and sorted; within a partition every distinct key
gets the next integer, the parents' integers are compressed into contiguous runs, and each
reference is matched as of the preceding run's start: beyond that run's end there is no parent.
All rows of one key fall into one partition, and after the first step a key has one row for each
column and month, however often it is referred to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.functions.text import iso_micros, letters_digits, ntz_micros, utc_text
from tripleloom.session import shuffle_partitions

_NEVER = 2**31 - 1


def month_number(micros: Column) -> Column:
    """Year and month as the number YYYYMM in UTC; null for null."""
    return utc_text(micros, "yyyyMM").cast("int")


def references(triples: DataFrame, aliases: DataFrame, members: DataFrame, communities: DataFrame) -> DataFrame:
    """Distinct (ref 0-3, period YYYYMM, key): subjects, objects that are no literals, alias ids, members.

    Null references do not count; a null object_is_literal means no literal. A reference whose row
    has no readable time has a null period. Repeated rows give one case.
    """
    seen = month_number(iso_micros(F.col("timestamp")))
    # one scan of triples, two references a row
    objects = F.when(~F.coalesce("object_is_literal", F.lit(False)), F.col("object"))
    t = (
        triples.select(
            seen.alias("period"),
            F.explode(F.array(F.struct(F.lit(0).alias("ref"), F.col("subject").alias("id")), F.struct(F.lit(1).alias("ref"), objects.alias("id")))).alias("r"),
        )
        .select("r.ref", "period", "r.id")
    )
    a = aliases.select(F.lit(2).alias("ref"), month_number(ntz_micros(F.col("resolved_at"))).alias("period"), F.col("alias_id").alias("id"))
    born = communities.groupBy("community_id").agg(F.min("created_at").alias("created_at"))
    m = (
        members.select("community_id", "entity_id")
        .distinct()
        .join(born, "community_id", "left")
        .select(F.lit(3).alias("ref"), month_number(ntz_micros(F.col("created_at"))).alias("period"), F.col("entity_id").alias("id"))
    )
    raw = t.union(a).union(m).filter("id is not null").distinct()  # as written, before the costlier normal form
    return raw.select("ref", "period", letters_digits(F.col("id")).alias("key")).distinct()


def parents(entities: DataFrame) -> DataFrame:
    """key, born (month of the earliest created_at), gone (month of the latest deleted_at); null ids do not count."""
    e = entities.filter("id is not null").select(letters_digits(F.col("id")).alias("key"), "created_at", "deleted_at")
    e = e.groupBy("key").agg(F.min("created_at").alias("b"), F.max("deleted_at").alias("g"))
    return e.select("key", month_number(ntz_micros(F.col("b"))).alias("born"), month_number(ntz_micros(F.col("g"))).alias("gone"))


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, parents (ref -1) before references; yields the orphans."""
    last_key, last_code = None, -1
    run_lo = run_hi = -2  # the run of parents that the last batch ended in
    last_born = last_gone = -1
    for b in batches:
        m = b.num_rows
        if not m:
            continue
        keys = b.column(0).dictionary_encode()
        at = keys.indices.to_numpy(zero_copy_only=False)
        codes = last_code + 1 + np.concatenate([[0], np.cumsum(at[1:] != at[:-1])])
        if last_key is not None and b.column(0)[0].as_py() == last_key:
            codes -= 1
        ref, period, born, gone = (b.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5))
        is_parent = ref < 0
        have = codes[is_parent]
        # contiguous runs of parent integers; the one carried over comes first
        starts, ends = np.array([run_lo]), np.array([run_hi])
        if len(have):
            cut = np.flatnonzero(np.diff(have) != 1)
            s, e = have[np.concatenate([[0], cut + 1])], have[np.concatenate([cut, [len(have) - 1]])]
            if s[0] == run_hi + 1:
                s = s.copy()
                s[0] = run_lo
                starts, ends = s, e
            else:
                starts, ends = np.concatenate([starts, s]), np.concatenate([ends, e])
        r = ~is_parent
        code, when = codes[r], period[r]
        run = np.searchsorted(starts, code, side="right") - 1
        inside = (run >= 0) & (code <= ends[np.maximum(run, 0)])
        # the parent's own months, by its integer
        own_code = np.concatenate([[last_code], have])
        own_born = np.concatenate([[last_born], born[is_parent]])
        own_gone = np.concatenate([[last_gone], gone[is_parent]])
        i = np.maximum(np.searchsorted(own_code, code, side="right") - 1, 0)
        late = inside & (own_born[i] > when) & (own_born[i] >= 0) & (when >= 0)
        deleted = inside & ~late & (own_gone[i] >= 0) & (own_gone[i] < when)
        state = np.where(~inside, 0, np.where(late, 1, np.where(deleted, 2, -1)))
        out = np.flatnonzero(state >= 0)
        if len(out):
            rows = np.flatnonzero(r)[out]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(ref[rows], pa.int32()), pa.array(period[rows], pa.int32()), pa.array(state[out], pa.int32())], names=["key", "ref", "period", "state"])
        run_lo, run_hi = int(starts[-1]), int(ends[-1])
        if len(have) and have[-1] == codes[-1]:
            last_born, last_gone = int(own_born[-1]), int(own_gone[-1])
        elif codes[-1] != last_code:
            last_born = last_gone = -1
        last_key, last_code = b.column(0)[m - 1].as_py(), int(codes[-1])


def find_orphans(refs: DataFrame, keys: DataFrame) -> DataFrame:
    """key, ref, period, state (0 missing, 1 late, 2 deleted) of the references without a live parent.

    ``refs`` (ref, period, key) must be distinct, ``keys`` (key, born, gone) one row a key. A null
    period is neither late nor deleted.
    """
    none = F.lit(-1)
    p = keys.select("key", F.lit(-1).alias("ref"), none.alias("period"), F.coalesce("born", none).alias("born"), F.coalesce("gone", none).alias("gone"))
    r = refs.select("key", "ref", F.coalesce("period", none).alias("period"), none.alias("born"), none.alias("gone"))
    both = p.union(r).repartitionByRange(shuffle_partitions(p.sparkSession), "key").sortWithinPartitions("key", "ref")
    found = both.mapInArrow(_match, "key string, ref int, period int, state int")
    return found.withColumn("period", F.when(F.col("period") >= 0, F.col("period")))


def orphan_report(triples: DataFrame, entities: DataFrame, aliases: DataFrame, members: DataFrame, communities: DataFrame) -> DataFrame:
    """table_name, column_name, period (YYYY-MM), ref_key, state: one row for each distinct case."""
    found = find_orphans(references(triples, aliases, members, communities), parents(entities))
    tables, columns, states = (F.array(*[F.lit(x) for x in xs]) for xs in (["triples", "triples", "entity_aliases", "community_members"], ["subject", "object", "alias_id", "entity_id"], ["missing", "late", "deleted"]))
    text = F.lpad(F.col("period").cast("string"), 6, "0")
    return found.select(
        F.get(tables, F.col("ref")).alias("table_name"),
        F.get(columns, F.col("ref")).alias("column_name"),
        F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2)).alias("period"),
        F.col("key").alias("ref_key"),
        F.get(states, F.col("state")).alias("state"),
    ).withColumn("period", F.when(F.col("period") != "", F.col("period")))
