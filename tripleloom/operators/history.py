"""History of changing entity attributes: versions with their periods of validity (problem 1).

Method: presence bitmaps. The snapshots of a subject and predicate are numbered in the order of
their starts; for each hash of (subject, predicate, value) two bits a snapshot are kept: the first
says the value was reported then, the second that it stayed valid up to the next snapshot. Runs of
consecutive bits are the versions; a period closed early leaves its second bit out, so the run
breaks there by itself. Bitmaps are kept in 64-bit words, aggregated map side, so a subject with a
third of all rows spreads over as many words as it needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.functions.text import iso_micros, squeeze, utc_text
from tripleloom.operators.ordered import sequence
from tripleloom.session import materialise

#: The predicates that report one attribute value of a subject.
ATTRIBUTES = ["HAS_STATUS", "MAINTAINED_BY", "IMPLEMENTED_IN", "ACHIEVES", "DEFINED_AS"]
OPEN_END = "9999-12-31T00:00:00Z"
_STAMP = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def snapshots(triples: DataFrame, predicates: list[str] = ATTRIBUTES) -> DataFrame:
    """The row that holds for each subject, predicate and start (µs): value, end (µs or null).

    Of rows with one start the latest timestamp holds, then the largest row_id; a null or unreadable
    timestamp is earliest. Rows without any readable start have no period and are left out. A null
    object is a value of its own; null subjects form one group.
    """
    start = F.coalesce(iso_micros(F.col("valid_from")), iso_micros(F.col("timestamp")))
    rows = triples.filter(F.col("predicate").isin(predicates)).select(
        "subject",
        "predicate",
        start.alias("start"),
        iso_micros(F.col("timestamp")).alias("seen"),
        F.col("row_id").cast("long").alias("row_id"),
        squeeze(F.col("object")).alias("value"),
        iso_micros(F.col("valid_to")).alias("until"),
    )
    held = rows.filter(F.col("start").isNotNull()).groupBy("subject", "predicate", "start").agg(F.max(F.struct("seen", "row_id", "value", "until")).alias("r"))
    return held.select(
        "subject", "predicate", "start", F.col("r.value").alias("value"), F.when(F.col("r.until") > F.col("start"), F.col("r.until")).alias("until"),
    )


def bit_runs(bits: DataFrame, key: list[str], bit: str) -> DataFrame:
    """Maximal runs of consecutive set bits: key columns, ``first`` and ``last`` bit number.

    One row of ``bits`` sets one bit. Words of 64 bits are or-ed together first; within a word runs
    are read off the word, and runs that touch a word's border are joined with the next word's.
    """
    word = (
        bits.withColumn("word", F.shiftright(F.col(bit), 6))
        .groupBy(*key, "word")
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col(bit).bitwiseAND(F.lit(63)).cast("int"))).alias("w"))
    )
    before = F.call_function("shiftleft", F.col("w"), F.lit(1))
    after = F.call_function("shiftrightunsigned", F.col("w"), F.lit(1))
    # A run that goes on over the border has an opening bit in one word and its closing bit in a later one:
    # the border bits are settled by looking at the neighbouring words' border bits.
    low = word.filter(F.col("w").bitwiseAND(F.lit(1)) != 0).select(*key, (F.col("word") - 1).alias("word"), F.lit(True).alias("goes_on"))
    high = word.filter(F.col("w") < 0).select(*key, (F.col("word") + 1).alias("word"), F.lit(True).alias("comes_in"))
    on = key + ["word"]
    marked = word.join(low, on, "left").join(high, on, "left")
    opening = F.col("w").bitwiseAND(F.bitwise_not(before.bitwiseOR(F.when(F.col("comes_in"), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))))
    top = F.lit(-(2**63)).cast("long")
    closing = F.col("w").bitwiseAND(F.bitwise_not(after.bitwiseOR(F.when(F.col("goes_on"), top).otherwise(F.lit(0).cast("long")))))
    numbers = F.sequence(F.lit(0), F.lit(63))

    def set_bits(w):
        return F.filter(numbers, lambda i: F.call_function("shiftrightunsigned", w, i).bitwiseAND(F.lit(1).cast("long")) != 0)

    edges = marked.select(
        *key, "word",
        F.explode(F.concat(F.transform(set_bits(opening), lambda i: F.struct(i.alias("i"), F.lit(0).alias("kind"))), F.transform(set_bits(closing), lambda i: F.struct(i.alias("i"), F.lit(1).alias("kind"))))).alias("e"),
    )
    return edges.select(*key, (F.col("word") * 64 + F.col("e.i")).alias("bit"), F.col("e.kind").alias("kind"))


def attribute_history(triples: DataFrame, predicates: list[str] = ATTRIBUTES) -> DataFrame:
    """Every version: subject, predicate, value, version_from, version_to (µs, null if open).

    See ``snapshots`` for nulls, ties and repeated rows. Values are equal apart from case and amount
    of white space. An empty table gives an empty result; other columns do not matter.
    """
    seq = materialise(sequence(snapshots(triples, predicates), ["subject", "predicate"], ["start"], "start", "snapshots"), "numbered")
    stays = F.col("until").isNull() | F.col("next_start").isNull() | (F.col("until") > F.col("next_start"))
    # pos is unique over all subjects, so the hash only has to keep neighbouring values apart; the position itself settles the subject.
    value_hash = F.xxhash64("subject", "predicate", F.coalesce(F.concat(F.lit("v"), F.col("value")), F.lit("n")))
    bits = seq.select(
        value_hash.alias("vh"),
        F.explode(F.when(stays & F.col("next_start").isNotNull(), F.array(F.col("pos") * 2, F.col("pos") * 2 + 1)).otherwise(F.array(F.col("pos") * 2))).alias("bit"),
    )
    edges = bit_runs(bits, ["vh"], "bit")
    opens = edges.filter("kind = 0").select((F.col("bit") / 2).cast("long").alias("pos"), F.lit(True).alias("opens"))
    closes = edges.filter("kind = 1").select((F.floor(F.col("bit") / 2)).cast("long").alias("pos"), F.lit(True).alias("closes"))
    marked = seq.join(opens, "pos", "left").join(closes, "pos", "left").filter("opens or closes")
    end = F.when(F.col("closes"), F.least("until", "next_start"))
    # Openings and closings alternate in the order of pos; the closing of an opening is the next marked row's.
    ordered = sequence(
        marked.select("pos", "subject", "predicate", "value", "start", F.coalesce("opens", F.lit(False)).alias("opens"), F.coalesce("closes", F.lit(False)).alias("closes"), F.struct(end.alias("end")).alias("fin")).withColumnRenamed("pos", "at"),
        ["subject", "predicate"], ["at"], "fin", "versions",
    )
    return (
        ordered.filter("opens")
        .select("subject", "predicate", "value", F.col("start").alias("version_from"), F.when(F.col("closes"), F.col("fin.end")).otherwise(F.col("next_fin.end")).alias("version_to"))
    )


def history_found(triples: DataFrame) -> DataFrame:
    """Versions with both times as text, open ends as 9999."""
    h = attribute_history(triples)
    return h.select(
        "subject", "predicate", utc_text(F.col("version_from"), _STAMP).alias("version_from"),
        F.coalesce(utc_text(F.col("version_to"), _STAMP), F.lit(OPEN_END)).alias("version_to"),
    )
