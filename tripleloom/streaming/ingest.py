"""Streaming ingest: new rows of text become triples as they arrive, idempotent by triple_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tripleloom.operators.rules import extract
from tripleloom.operators.store import TripleStore


def ingest_stream(
    texts: DataFrame, store: TripleStore, checkpoint: str, timestamp: str, adapter: str = "universal", doc: str = "doc_id", text: str = "text",
    path: str = "relative_path", max_facts: int | None = None,
) -> StreamingQuery:
    """Run the rule pipeline on each micro-batch of a stream of texts, each of which appends its new rows
    to the store. A batch that runs again after a failure adds nothing twice, as inserts skip known ids."""

    def batch(df: DataFrame, _: int) -> None:
        store.add(extract(df, adapter, doc, text, path, max_facts=max_facts).withColumn("timestamp", F.lit(timestamp)), "place", "source_doc")

    return texts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rate_window(events: DataFrame, key: str, ts: str, seconds: int = 60) -> DataFrame:
    """``events`` with ``in_window``: how many events of the key lie in the last ``seconds``, itself included.

    Counted by buckets of the window's length, so a hot key is cut along time: an event meets only
    the events of its own bucket and the one before.
    """
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    span = seconds * 1_000_000
    e = events.withColumn("_t", t).withColumn("_b", F.floor(F.col("_t") / span))
    # every event also stands in the next bucket, where it is counted but not returned
    both = e.withColumn("_own", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("_b", F.when(F.col("_own"), F.col("_b")).otherwise(F.col("_b") + 1))
    w = Window.partitionBy(key, "_b").orderBy("_t").rangeBetween(-span, 0)
    return both.withColumn("in_window", F.count(F.lit(1)).over(w)).filter("_own").drop("_t", "_b", "_own")
