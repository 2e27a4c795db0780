"""Mixing sources to target weights (problem 9).

Method: Poisson replication. A hash of document, seed and source gives a uniform number u; the
document is repeated as often as the inverse Poisson distribution says for u and its source's mean
rate, at most max_repeats times, exploded, and shuffled globally by a second hash.

The rate is not guessed: for fixed u a document's k-th copy appears exactly when the rate passes
the threshold t_k(u), so a source's tokens are a step function of its rate. The thresholds are solved
once a document and written; the function is read off by histograms of them (three rounds of fixed
size for each source), which gives the largest rate that does not pass the target. What is open then,
less than one copy, is filled by a few documents that fit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripleloom.functions.text import strip
from tripleloom.llm.sizes import DEFAULT_VOCABULARY, with_tokens
from tripleloom.session import materialise, shuffle_partitions

#: Cells of one histogram and rounds of refinement: 4096^3 steps of the rate.
CELLS, ROUNDS = 4096, 3
#: Copies of a source that are chosen to fill what the Poisson draw leaves open, at most.
FITS = 16


def source_name(c: Column) -> Column:
    """Sources are written unevenly: case, outer white space, '-' and blanks for '_'."""
    return F.regexp_replace(F.lower(strip(c)), r"[-\s]+", "_")


def uniform(seed: int, *cols: Column) -> Column:
    """A hash as a number in (0, 1): 53 bits."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") + 0.5) / float(1 << 53)


def thresholds(u: np.ndarray, most: int) -> np.ndarray:
    """t[i, k - 1]: the Poisson rate from which document i has k copies or more: P(X < k) = 1 - u there.

    Solved by bisection of the cumulative distribution, which falls strictly with the rate.
    """
    lo, hi = np.zeros((len(u), most)), np.full((len(u), most), _top(most))
    want = (1.0 - u)[:, None]
    for _ in range(60):
        mid = (lo + hi) / 2
        term = np.exp(-mid)
        below = np.zeros_like(mid)
        for k in range(most):
            below[:, k:] += term[:, k:]
            term = term * mid / (k + 1)
        above = below > want  # still fewer than k copies
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return hi


def copies(u: Column, rate: Column, most: int) -> Column:
    """The inverse Poisson distribution at u, at most ``most``: how many k have P(X < k) <= 1 - u."""
    term, below, n = F.exp(-rate), F.lit(0.0), F.lit(0)
    for k in range(most):
        below = below + term
        n = n + (below <= 1.0 - u).cast("int")
        term = term * rate / (k + 1)
    return n


def targets(mix: DataFrame) -> list[tuple[str, float, int]]:
    """The settings: (source, share, max_repeats); rows without source or positive share are left out,
    of repeated sources the largest share holds. Shares are scaled to sum 1."""
    rows = (
        mix.select(source_name(F.col("source")).alias("s"), "target_share", "max_repeats")
        .filter("s is not null and target_share > 0")
        .groupBy("s")
        .agg(F.max(F.struct("target_share", "max_repeats")).alias("r"))
        .orderBy("s")
        .collect()
    )
    total = math.fsum(r["r"]["target_share"] for r in rows)
    return [(r["s"], r["r"]["target_share"] / total, max(1, r["r"]["max_repeats"] or 1)) for r in rows]


def _caps(spark, mix: list[tuple[str, float, int]]) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(s, c) for s, _, c in mix] or [("", 1)], "source string, most int"))  # one row a source of the settings


def sizes(documents: DataFrame, mix: list[tuple[str, float, int]], seed: int, vocabulary: str) -> DataFrame:
    """(doc_id, source, n_tokens, t) of the documents of the mixture's sources, written once: t holds the
    rates from which a document has 1, 2, ... copies, as many as its source may repeat it."""
    named = documents.filter("doc_id is not null").select("doc_id", source_name(F.col("source")).alias("source"), "text")
    named = named.join(_caps(documents.sparkSession, mix), "source").withColumn("u", uniform(seed, F.col("doc_id")))
    most = max((c for _, _, c in mix), default=1)
    counted = with_tokens(named, "text", ["doc_id", "source", "u", "most"], vocabulary).filter("n_tokens > 0")

    def rates(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            t = thresholds(f["u"].to_numpy(), most)
            f["t"] = [row[:m] for row, m in zip(t, f["most"], strict=True)]
            yield f[["doc_id", "source", "n_tokens", "t"]]

    schema = T.StructType([counted.schema["doc_id"], counted.schema["source"], counted.schema["n_tokens"], T.StructField("t", T.ArrayType(T.DoubleType()))])
    return materialise(counted.mapInPandas(rates, schema), "sizes")


def _drawn() -> Column:
    """The copies that a source's ``rate`` draws of a document with thresholds ``t``."""
    return F.size(F.filter("t", lambda x: x <= F.col("rate")))


def _top(most: int) -> float:
    """A rate beyond every threshold."""
    return 50.0 + 4.0 * most


def calibrate(sized: DataFrame, mix: list[tuple[str, float, int]], budget: float | None) -> list[tuple[str, float, int, float]]:
    """(source, rate, max_repeats, tokens wanted) for each source that has tokens: the rate is the largest
    at which the tokens drawn do not exceed those wanted."""
    spark = sized.sparkSession
    have = {r["source"]: r["t"] for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}  # one row a source of the settings
    there = [(s, w, c) for s, w, c in mix if have.get(s)]
    if not there:
        return []
    share = math.fsum(w for _, w, _ in there)
    if budget is None:
        budget = min(c * have[s] / (w / share) for s, w, c in there)
    wanted = {s: min(c * have[s], budget * w / share) for s, w, c in there}
    caps = {s: c for s, _, c in there}
    top = _top(max(c for _, _, c in mix))
    low, width, base = dict.fromkeys(caps, 0.0), dict.fromkeys(caps, top), dict.fromkeys(caps, 0.0)
    steps = sized.select("source", "n_tokens", F.explode("t").alias("x"))
    for _ in range(ROUNDS):
        span = F.broadcast(spark.createDataFrame([(s, low[s], width[s]) for s in caps], "source string, low double, width double"))
        cell = F.floor((F.col("x") - F.col("low")) / F.col("width") * CELLS)
        found = (
            steps.join(span, "source")
            .withColumn("cell", cell)
            .filter((F.col("cell") >= 0) & (F.col("cell") < CELLS))
            .groupBy("source", "cell")
            .agg(F.sum("n_tokens").alias("tokens"))
        )
        hist = found.toPandas()  # at most CELLS rows a source
        for s in caps:
            v = np.zeros(CELLS)
            h = hist[hist["source"] == s]
            v[h["cell"].to_numpy(int)] = h["tokens"].to_numpy()
            run = base[s] + np.cumsum(v)
            i = min(int(np.searchsorted(run, wanted[s], side="right")), CELLS - 1)  # the first cell that goes beyond the target
            base[s] = float(run[i] - v[i])
            low[s] += i * width[s] / CELLS
            width[s] /= CELLS
    return [(s, low[s] if wanted[s] < caps[s] * have[s] else top, caps[s], wanted[s]) for s in caps]


def fitted(sized: DataFrame, rates: list[tuple[str, float, int, float]]) -> DataFrame:
    """(source, doc_id): documents that get one copy more, so that a source's tokens meet those wanted.

    What the rate leaves open is less than the next copy's size, which may be a long document. It is
    filled by the longest document with a copy to spare that fits, then the next, at most ``FITS`` a
    source: these few copies are chosen by size, all others by the Poisson draw.
    """
    spark = sized.sparkSession
    schema = "source string, rate double, open double"
    chosen: list[tuple[str, object]] = []
    kind = sized.schema["doc_id"].dataType.simpleString()
    table = spark.createDataFrame([(s, r, 0.0) for s, r, _, _ in rates], schema)
    # rows with one doc_id are drawn alike, so they count together
    per = materialise(sized.groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.first("t").alias("t")), "documents")
    got = {r["source"]: r["n"] for r in per.join(F.broadcast(table), "source").groupBy("source").agg(F.sum(_drawn() * F.col("n_tokens")).alias("n")).collect()}
    left = {s: w - got.get(s, 0) for s, _, _, w in rates}
    for _ in range(FITS):
        spans = spark.createDataFrame([(s, r, float(left[s])) for s, r, _, _ in rates if left[s] >= 1], schema)
        taken = F.broadcast(spark.createDataFrame(chosen, f"source string, doc_id {kind}"))  # FITS rows a source at most
        free = per.join(F.broadcast(spans), "source").filter((F.col("n_tokens") <= F.col("open")) & (_drawn() < F.size("t")))
        best = free.join(taken, ["source", "doc_id"], "left_anti").groupBy("source").agg(F.max(F.struct("n_tokens", "doc_id")).alias("b")).collect()
        for r in best:
            chosen.append((r["source"], r["b"]["doc_id"]))
            left[r["source"]] -= r["b"]["n_tokens"]
        if not best:
            break
    return spark.createDataFrame(chosen, f"source string, doc_id {kind}").withColumn("more", F.lit(1))


def prepare(documents: DataFrame, mix: DataFrame, seed: int, vocabulary: str, budget: float | None) -> tuple[DataFrame, list, list, DataFrame]:
    """Sizes of the documents, the settings, ``calibrate``'s rows and ``fitted``'s documents."""
    settings = targets(mix)
    sized = sizes(documents, settings, seed, vocabulary)
    rates = calibrate(sized, settings, budget)
    return sized, settings, rates, fitted(sized, rates)


def mixture(
    documents: DataFrame, mix: DataFrame, seed: int = 7, vocabulary: str = DEFAULT_VOCABULARY, budget: float | None = None,
    carry: tuple[str, ...] = ("text",),
) -> DataFrame:
    """(place, doc_id, copy_no, source, *carry): the mixture, in random order of ``place`` over the whole result.

    ``budget`` is the size of the mixture in tokens. Without it the mixture is the largest in which every
    source with documents has its share within its cap: a larger one cannot have the target shares, which
    are what is asked for. With a larger budget, sources whose cap is reached fall short, as ``mixture_shares`` says.

    Documents with null ids, of sources without target or without tokens are never drawn; rows with
    one doc_id are drawn alike. Same seed, same result, whatever the partitioning.
    """
    _, _, rates, more = prepare(documents, mix, seed, vocabulary, budget)
    spark = documents.sparkSession
    table = F.broadcast(spark.createDataFrame([(s, r, c) for s, r, c, _ in rates], "source string, rate double, most int"))  # one row a source
    most = max((c for _, _, c, _ in rates), default=1)
    kept = [c for c in carry if c not in ("doc_id", "source")]
    docs = (
        documents.filter("doc_id is not null")
        .select("doc_id", source_name(F.col("source")).alias("source"), *kept, (F.length("text") > 0).alias("_sized"))
        .filter("_sized")
        .drop("_sized")
    )
    n = F.least("most", copies(uniform(seed, F.col("doc_id")), F.col("rate"), most)) + F.coalesce("more", F.lit(0))
    drawn = (
        docs.join(table, "source")
        .join(F.broadcast(more), ["source", "doc_id"], "left")
        .withColumn("n", n)
        .filter("n > 0")
        .withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("n"))))
        .drop("rate", "most", "n", "more")
    )
    drawn = drawn.withColumn("place", uniform(seed + 1, F.col("doc_id"), F.col("copy_no")))
    parts = shuffle_partitions(spark)
    # the place is uniform, so equal ranges of it are equal partitions: no sampling pass
    return (
        drawn.repartitionById(parts, F.floor(F.col("place") * parts).cast("int"))
        .sortWithinPartitions("place", "doc_id", "copy_no")
        .select("place", "doc_id", "copy_no", "source", *kept)
    )


def mixture_shares(documents: DataFrame, mix: DataFrame, seed: int = 7, vocabulary: str = DEFAULT_VOCABULARY, budget: float | None = None) -> DataFrame:
    """source, target_share, reachable_share (without sources that have no tokens), actual_share,
    tokens, documents drawn, copies, max_copies: a row for each source of ``mix``."""
    sized, settings, rates, more = prepare(documents, mix, seed, vocabulary, budget)
    spark = documents.sparkSession
    by = {s: r for s, r, _, _ in rates}
    present = math.fsum(w for s, w, _ in settings if s in by) or 1.0
    rows = [(s, w, w / present if s in by else 0.0, by.get(s, 0.0)) for s, w, _ in settings]
    table = spark.createDataFrame(rows, "source string, target_share double, reachable_share double, rate double")
    n = _drawn() + F.coalesce("more", F.lit(0))
    drawn = (
        sized.join(F.broadcast(table), "source")
        .join(F.broadcast(more), ["source", "doc_id"], "left")
        .withColumn("n", n)
        .groupBy("source")
        .agg(F.sum(F.col("n") * F.col("n_tokens")).alias("tokens"), F.sum((F.col("n") > 0).cast("long")).alias("documents"), F.sum("n").cast("long").alias("copies"), F.max("n").alias("max_copies"))
    )
    full = (
        table.join(drawn, "source", "left")
        .select("source", "target_share", "reachable_share", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("max_copies", F.lit(0)).alias("max_copies"))
    )
    full = full.withColumn("all_tokens", F.sum("tokens").over(Window.partitionBy(F.lit(0))))  # one row a source of the settings
    return full.select(
        "source", "target_share", "reachable_share",
        F.when(F.col("all_tokens") > 0, F.col("tokens") / F.col("all_tokens")).otherwise(0.0).alias("actual_share"), "tokens", "documents", "copies",
        "max_copies",
    )
