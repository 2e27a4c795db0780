"""Long exact spans shared between records (problem 10).

Method: repeated-phrase automata.

1. Fingerprints. Every window of ``run`` characters selects the least of the hashes of its
   ``phrase``-character grams; equal windows select the same gram, so two documents that share a
   window share a selected gram. Some 2 in (run - phrase + 2) grams are selected. Documents are read
   once, into blocks of some two million characters, which are written compressed with the hashes that
   each block selects.
2. Recurring phrases are the grams selected in more than one document. A block is told those that it
   selected; their texts stand in the block itself.
3. Automata. From the recurring phrases of each block, pyahocorasick automata of bounded size are
   compiled, and all documents of the block are streamed through them, whole, which locates every
   occurrence character by character, selected or not. The shards are the blocks' phrases: what a block
   did not select cannot be in a run that one of its documents shares, so no document need meet the
   phrases of other blocks, and the work grows with the documents instead of documents times phrases.
4. Confirmation. Each window belongs to the phrase that it selects. Neighbouring windows of one
   occurrence make a passage; a passage that stands in two documents (by 128 bits of its text) is shared
   whole, and where a phrase has passages that stand in one document only, its passages are compared
   window by window, character by character.
5. Shared windows of a document are merged and their characters counted.

A phrase or passage travels once a block, however many documents have it, so one copied into a third of all
documents stays cheap, and no pairs of documents are made. A phrase with very many different passages is
compared by aggregation of its windows instead of in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripleloom.session import discard, materialise

RUN = 150
PHRASE = 75
#: Window starts hashed at a time: 2 MB a vector.
CHUNK = 1 << 18
#: Characters of a block of documents; a longer document is a block of its own.
BLOCK = 1 << 21
#: Phrases of one automaton.
SHARD = 20_000
#: Passages of a phrase that one task compares; phrases with more are compared by aggregation.
TOGETHER = 2000
#: Pairs of windows compared character by character at a time.
PAIRS = 1 << 14

_MASK = (1 << 64) - 1
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n + 1, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p, out=p)


class Hasher:
    """Rolling hashes of all grams of a text, modulo 2^64 and mixed: what they find equal is compared as text later."""

    def __init__(self, size: int):
        self.up, self.down = _powers(_BASE, size), _powers(_INVERSE, size)

    def prefix(self, codes: np.ndarray) -> np.ndarray:
        p = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes + np.uint64(1)) * self.up[: len(codes)], out=p[1:])
        return p

    def grams(self, prefix: np.ndarray, k: int) -> np.ndarray:
        h = (prefix[k:] - prefix[:-k]) * self.down[: len(prefix) - k]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return h


def _sliding(a: np.ndarray, w: int, op: np.ufunc, fill: int) -> np.ndarray:
    """op over a[i : i + w] for every i, in two passes over blocks of w."""
    m = len(a)
    padded = np.full(-(-m // w) * w, fill, a.dtype)
    padded[:m] = a
    blocks = padded.reshape(-1, w)
    ahead = op.accumulate(blocks, axis=1).ravel()
    back = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[: m - w + 1], ahead[w - 1 : m])


def selected(codes: np.ndarray, run: int, phrase: int, hasher: Hasher, windows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all grams, whether each gram is selected, least hash of each window)."""
    w = run - phrase + 1
    h = hasher.grams(hasher.prefix(codes), phrase)
    least = _sliding(h, w, np.minimum, _MASK)
    held = least if windows is None else np.where(windows, least, np.uint64(0))
    # a gram is selected iff its hash is the least of some window that holds it
    padded = np.zeros(len(held) + 2 * (w - 1), np.uint64)
    padded[w - 1 : w - 1 + len(held)] = held
    return h, h == _sliding(padded, w, np.maximum, 0), least


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class Piece:
    """A stretch of neighbouring documents that is hashed at once; a long document has several, which
    overlap by ``run`` - 1 characters, so that every window lies in one."""

    def __init__(self, parts: list[tuple[int, int, str]], run: int, phrase: int, hasher: Hasher):
        self.text = "".join(t for _, _, t in parts)
        self.lens = np.array([len(t) for _, _, t in parts])
        self.begin = np.cumsum(self.lens) - self.lens
        self.doc, self.offset = np.array([d for d, _, _ in parts], np.int64), np.array([o for _, o, _ in parts], np.int64)
        self.inside = self._within(run)  # windows that lie in one document
        self.h, self.sel, self.least = selected(_codes(self.text), run, phrase, hasher, self.inside)

    def _within(self, size: int) -> np.ndarray:
        ok = np.zeros(len(self.text) - size + 1, np.int8)
        long = self.lens >= size
        np.add.at(ok, self.begin[long], 1)
        ends = (self.begin + self.lens - size + 1)[long]
        np.subtract.at(ok, ends[ends < len(ok)], 1)
        return np.cumsum(ok, dtype=np.int8) > 0

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, at, side="right") - 1


def _pieces(docs: list[tuple[int, str]], run: int, phrase: int, hasher: Hasher, chunk: int) -> Iterator[Piece]:
    parts, size = [], 0
    for doc, t in docs:
        for o in range(0, len(t) - run + 1, chunk - run):
            part = t[o : o + chunk - 1] if len(t) > chunk - 1 else t
            if len(part) < run:
                continue
            if size + len(part) > chunk:
                yield Piece(parts, run, phrase, hasher)
                parts, size = [], 0
            parts.append((doc, o, part))
            size += len(part)
    if parts:
        yield Piece(parts, run, phrase, hasher)


_BLOCKS = "gid long, h long, lo long, hi long, docs array<long>, lens array<int>, blob binary, size long"


def _fingerprints(run: int, phrase: int):
    """Documents (doc, text) -> blocks: a row (gid, h, least document, greatest if it is another) for each
    gram that the block selects, and a row with the block's documents."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, zstd = Hasher(CHUNK + run), pa.Codec("zstd")
        base, number = TaskContext.get().partitionId() << 32, 0
        longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())

        def close(docs: list[tuple[int, str]]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            gid, number = base | number, number + 1
            hs, ds = [], []
            for p in _pieces(docs, run, phrase, hasher, CHUNK):
                at = np.flatnonzero(p.sel)
                hs.append(p.h[at])
                ds.append(p.doc[p.owner(at)])
            h, d = np.concatenate(hs), np.concatenate(ds)
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            first = np.concatenate([[True], h[1:] != h[:-1]])
            last = np.concatenate([h[1:] != h[:-1], [True]])
            n = int(first.sum())
            none = [pa.nulls(n, x) for x in (longs, ints, pa.binary(), pa.int64())]
            raw = "".join(t for _, t in docs).encode("utf-8", "surrogatepass")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, gid)), pa.array(h[first].view(np.int64)), pa.array(d[first]), pa.array(d[last], mask=d[last] == d[first]), *none], names=_NAMES)
            whole = [pa.array([[x for x, _ in docs]], longs), pa.array([[len(t) for _, t in docs]], ints), pa.array([zstd.compress(raw, asbytes=True)], pa.binary()), pa.array([len(raw)], pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([gid], pa.int64()), *[pa.nulls(1, pa.int64())] * 3, *whole], names=_NAMES)

        docs, size = [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = text.as_py()
                if docs and size + len(t) > BLOCK:
                    yield from close(docs)
                    docs, size = [], 0
                docs.append((doc, t))
                size += len(t)
        if docs:
            yield from close(docs)

    return scan


_NAMES = [c.split()[0] for c in _BLOCKS.split(", ")]
_PASSAGES = "h long, x long, y long, doc long, a long, z long, lo long, hi long, passage string"


def _hits(pieces: list[Piece], wanted: np.ndarray, phrase: int) -> list[list[int]]:
    """Where the recurring phrases stand in each piece, by automata over all the block's documents."""
    import ahocorasick

    phrases: dict[str, None] = {}
    for p in pieces:
        at = np.flatnonzero(p.sel)
        for i in at[np.isin(p.h[at], wanted)].tolist():
            phrases[p.text[i : i + phrase]] = None
    words, found = list(phrases), [[] for _ in pieces]
    for i in range(0, len(words), SHARD):
        shard = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for w in words[i : i + SHARD]:
            shard.add_word(w)
        shard.make_automaton()
        for hits, p in zip(found, pieces, strict=True):
            hits.extend(end - phrase + 1 for end, _ in shard.iter(p.text))
    return found


def _located(run: int, phrase: int):
    """Blocks with the hashes of their recurring phrases -> passages: windows that neighbour each other and
    select the same recurring phrase. The first of equal passages of a block carries its text and documents."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, zstd = Hasher(CHUNK + run), pa.Codec("zstd")
        names = [c.split()[0] for c in _PASSAGES.split(", ")]
        types = [pa.int64()] * 8 + [pa.string()]
        for b in batches:
            for docs, lens, blob, size, hs in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                text = zstd.decompress(blob, size, asbytes=True).decode("utf-8", "surrogatepass")
                ends = np.cumsum(lens).tolist()
                pieces = list(_pieces([(d, text[e - n : e]) for d, n, e in zip(docs, lens, ends, strict=True)], run, phrase, hasher, CHUNK))
                rows: list[tuple] = []
                seen: dict[tuple[int, int, int], list] = {}
                for p, hits in zip(pieces, _hits(pieces, np.array(hs, np.int64).view(np.uint64), phrase), strict=True):
                    recurring = np.unique(p.h[hits])
                    if not len(recurring):
                        continue
                    mine = p.inside & (recurring[np.minimum(np.searchsorted(recurring, p.least), len(recurring) - 1)] == p.least)
                    turn = p.least[1:] != p.least[:-1]
                    opens = np.flatnonzero(mine & np.concatenate([[True], turn | ~mine[:-1]]))
                    closes = np.flatnonzero(mine & np.concatenate([turn | ~mine[1:], [True]]))
                    who = p.owner(opens)
                    at = opens - p.begin[who] + p.offset[who]
                    for a, z, d, o, h in zip(opens.tolist(), closes.tolist(), p.doc[who].tolist(), at.tolist(), p.least[opens].view(np.int64).tolist(), strict=True):
                        passage = p.text[a : z + run]
                        k = xxhash.xxh3_128_intdigest(passage.encode("utf-8", "surrogatepass"))
                        key = (h, (k >> 64) - (1 << 63), (k & _MASK) - (1 << 63))
                        held = seen.get(key)
                        if held is None:
                            seen[key] = held = [d, d, passage]
                        else:
                            held[0], held[1] = min(held[0], d), max(held[1], d)
                        rows.append((*key, d, o, o + z - a))
                cols = [*zip(*rows, strict=True)] if rows else [()] * 6
                kinds = [None] * len(rows)
                for i, r in enumerate(rows):
                    kinds[i] = seen.pop(r[:3], None) or (None, None, None)
                lo, hi, passages = zip(*kinds, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip([*cols, lo, hi, passages], types, strict=True)], names=names)

    return scan


def _window_rows(texts: list[str], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(characters of all passages, passage, position and hash of every window)."""
    codes = _codes("".join(texts))
    n = np.array([len(t) for t in texts])
    begin, count = np.cumsum(n) - n, n - run + 1
    row = np.repeat(np.arange(len(texts)), count)
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    hasher = Hasher(len(codes))
    return codes, row, step, hasher.grams(hasher.prefix(codes), run)[begin[row] + step]


def _compared(run: int):
    """Rows (h, x, y, lo, hi, passage) sorted by h -> stretches (h, x, y, s0, s1) of the passages of one
    document whose windows stand in another document's passage of the same phrase."""

    def compare(h, x, y, lo, hi, texts) -> pa.RecordBatch:
        codes, row, step, w = _window_rows(texts, run)
        begin = np.cumsum([len(t) for t in texts]) - np.array([len(t) for t in texts])
        order = np.lexsort((w, h[row]))
        r, at = row[order], (begin[row] + step)[order]
        same = (h[r][1:] == h[r][:-1]) & (w[order][1:] == w[order][:-1])
        near = np.flatnonzero(same)
        chars = codes.astype(np.uint32)
        for i in range(0, len(near), PAIRS):  # equal hashes are confirmed as text
            k = near[i : i + PAIRS]
            span = np.arange(run)
            same[k] = (chars[at[k][:, None] + span] == chars[at[k + 1][:, None] + span]).all(axis=1)
        group = np.concatenate([[0], np.cumsum(~same)]) if len(r) else np.zeros(0, int)
        starts = np.flatnonzero(np.concatenate([[True], np.diff(group) > 0])) if len(r) else np.zeros(0, int)
        shared = np.minimum.reduceat(lo[r], starts) != np.maximum.reduceat(hi[r], starts) if len(r) else np.zeros(0, bool)
        hit = np.flatnonzero(shared[group] & (lo[r] == hi[r])) if len(r) else np.zeros(0, int)
        rr, ss = r[hit], step[order][hit]
        o = np.lexsort((ss, rr))
        rr, ss = rr[o], ss[o]
        new = np.concatenate([[True], (rr[1:] != rr[:-1]) | (ss[1:] != ss[:-1] + 1)]) if len(rr) else np.zeros(0, bool)
        end = np.concatenate([new[1:], [True]]) if len(rr) else new
        k = rr[new]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (h[k], x[k], y[k], ss[new], ss[end])], names=["h", "x", "y", "s0", "s1"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # the passages of the last phrase: at most ``TOGETHER``

        def flush(t: pa.Table) -> pa.RecordBatch:
            return compare(*(t.column(i).to_numpy() for i in range(5)), t.column(5).to_pylist())

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            hs = t.column(0).to_numpy()
            cut = int(np.searchsorted(hs, hs[-1]))  # the last phrase may go on in the next batch
            ready = pa.concat_tables([*held, t.slice(0, cut)]) if held else t.slice(0, cut)
            if held and hs[0] == hs[-1] and held[-1].column(0)[-1].as_py() == hs[-1]:
                held.append(t)
                continue
            for part in _whole(ready):
                yield flush(part)
            held = [t.slice(cut)]
        if held:
            for part in _whole(pa.concat_tables(held)):
                yield flush(part)

    return scan


def _whole(t: pa.Table, rows: int = 4096) -> Iterator[pa.Table]:
    """The table in parts of some ``rows`` rows that end where a phrase ends."""
    hs = t.column(0).to_numpy()
    at = 0
    while at < len(hs):
        end = min(at + rows, len(hs))
        if end < len(hs):
            end = max(int(np.searchsorted(hs, hs[end - 1], side="right")), end) if hs[end - 1] == hs[end] else end
        yield t.slice(at, end - at)
        at = end


def _windows(run: int):
    """Rows (h, x, y, lo, hi, passage): one row for each window of the passage, by 128 bits of its text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "x", "y", "lo", "hi", "w", "v", "step"]
        for b in batches:
            for i in range(b.num_rows):
                t = b.column(5)[i].as_py()
                k = [xxhash.xxh3_128_intdigest(t[j : j + run].encode("utf-8", "surrogatepass")) for j in range(len(t) - run + 1)]
                same = [pa.array([b.column(c)[i].as_py()] * len(k), pa.int64()) for c in range(5)]
                w, v = pa.array([(d >> 64) - (1 << 63) for d in k], pa.int64()), pa.array([(d & _MASK) - (1 << 63) for d in k], pa.int64())
                yield pa.RecordBatch.from_arrays([*same, w, v, pa.array(range(len(k)), pa.int64())], names=names)

    return scan


def _by_aggregation(kinds: DataFrame, run: int) -> DataFrame:
    """What ``_compared`` gives, for phrases whose passages are too many for one task."""
    windows = materialise(kinds.mapInArrow(_windows(run), "h long, x long, y long, lo long, hi long, w long, v long, step long"), "windows")
    shared = windows.groupBy("h", "w", "v").agg(F.min("lo").alias("l"), F.max("hi").alias("m")).filter("l <> m").select("h", "w", "v")
    lone = windows.filter("lo = hi").join(shared, ["h", "w", "v"], "left_semi").select("h", "x", "y", "step")
    at = Window.partitionBy("h", "x", "y").orderBy("step")  # a passage is bounded by its document
    return (
        lone.withColumn("g", F.col("step") - F.row_number().over(at))
        .groupBy("h", "x", "y", "g")
        .agg(F.min("step").alias("s0"), F.max("step").alias("s1"))
        .drop("g")
    )


def shared_spans(documents: DataFrame, doc: str = "doc_id", text: str = "text", run: int = RUN, phrase: int = PHRASE, together: int = TOGETHER) -> DataFrame:
    """(doc, start, stop): maximal stretches, possibly touching, of each document that consist of runs
    of ``run`` characters (code points) which also stand in another document; stop is exclusive.

    Null ids, null texts and texts under ``run`` characters share nothing. Rows with one id count as
    one document: what only they share is not shared; positions are those in the row's own text, so
    different texts under one id should be told apart by another id. Other columns do not matter.
    """
    docs = documents.filter(F.col(doc).isNotNull() & (F.length(text) >= run)).select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text"))
    blocks = materialise(docs.mapInArrow(_fingerprints(run, phrase), _BLOCKS), "blocks")
    # a row a phrase and block: a phrase of very many documents is one of as many rows as there are blocks
    by = Window.partitionBy("h")
    prints = blocks.filter("h is not null").select("h", "gid", "lo", "hi")
    recurring = prints.withColumn("l", F.min("lo").over(by)).withColumn("m", F.max(F.coalesce("hi", "lo")).over(by)).filter("l <> m").select("gid", "h")
    wanted = recurring.groupBy("gid").agg(F.collect_list("h").alias("hs"))  # bounded by the block
    told = blocks.filter("h is null").select("gid", "docs", "lens", "blob", "size").join(wanted, "gid").select("docs", "lens", "blob", "size", "hs")
    passages = materialise(told.mapInArrow(_located(run, phrase), _PASSAGES), "passages")
    discard(blocks)
    kinds = passages.filter("passage is not null").select("h", "x", "y", "lo", "hi", "passage").repartition("h")  # a row a passage and block
    kinds = kinds.groupBy("h", "x", "y").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("passage").alias("passage"))
    lone = F.max((F.col("lo") == F.col("hi")).cast("int")).over(by)
    kinds = materialise(kinds.withColumn("lone", lone).withColumn("n", F.count(F.lit(1)).over(by)), "kinds")
    open_ = kinds.filter("lone = 1")
    order = ["h", "x", "y", "lo", "hi", "passage"]
    few = (
        open_.filter(F.col("n") <= together)
        .select(*order)
        .repartition("h")
        .sortWithinPartitions("h")
        .mapInArrow(_compared(run), "h long, x long, y long, s0 long, s1 long")
    )
    many = _by_aggregation(open_.filter(F.col("n") > together).select(*order), run)
    whole = kinds.filter("lo <> hi").select("h", "x", "y", F.lit(0).cast("long").alias("s0"), F.lit(None).cast("long").alias("s1"))
    found = whole.union(few).union(many.select("h", "x", "y", "s0", "s1"))
    every = passages.select("h", "x", "y", "doc", "a", "z").join(found, ["h", "x", "y"])
    return every.select("doc", (F.col("a") + F.col("s0")).alias("start"), (F.coalesce(F.col("a") + F.col("s1"), F.col("z")) + run).alias("stop"))


def merged(spans: DataFrame) -> DataFrame:
    """(doc, start, stop) without overlaps; a document's spans are bounded by its length."""
    w = Window.partitionBy("doc").orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    group = F.sum(F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return spans.withColumn("g", group).groupBy("doc", "g").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).select("doc", "start", "stop")


def shared_chars(documents: DataFrame, doc: str = "doc_id", text: str = "text", run: int = RUN, phrase: int = PHRASE) -> DataFrame:
    """(doc_id, shared_chars): each document with a shared run and how many of its characters lie in one."""
    return (
        merged(shared_spans(documents, doc, text, run, phrase))
        .groupBy(F.col("doc").alias("doc_id"))
        .agg(F.sum(F.col("stop") - F.col("start")).cast("long").alias("shared_chars"))
    )
