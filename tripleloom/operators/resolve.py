"""Entity resolution of the graph store: exact forms, blocked similarity, structural links.

Names equal after normalisation are one class before anything is compared, so similarity runs on
class representatives and the result is pairs between classes plus the membership. Blocks are cut
into cells of at most ``CELL`` members: a block's pairs are made cell against cell, so a hot prefix
is many equal tasks and no member meets itself twice.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.functions.naming import NameColumns, NameGrid, initialism, initials, jaro_winkler, may_reach, normalise, phonetic_key
from tripleloom.operators.graph import components, shortest_first, spanning_links
from tripleloom.operators.hierarchy import find_loops
from tripleloom.operators.ordered import sequence
from tripleloom.operators.vectors import encode
from tripleloom.schema import AUTO_MERGE, FLAG_FLOOR, SEMANTIC_FLOOR, STRING_WEIGHT, triple_id
from tripleloom.session import materialise, shuffle_partitions

#: Members of a cell of a block, and kinds up to which all pairs of a kind are compared.
CELL, SMALL_KIND = 2000, 256
#: Members of a cell where pairs are compared as they meet, tasks that share the members of two such cells, and groups
#: that blocks of one cell are dealt out to. Large cells cost less a pair, and tasks that share them keep all cores busy.
NEAR_CELL, CELL_SHARES, BLOCK_GROUPS = 16_000, 4, 512
#: The same where only links that join groups are kept, and the members of a cell that a task compares with all others.
LINK_CELL, LINK_ROWS = 64_000, 4_000
#: Score of a name and its initials.
SHORT_SCORE = 0.97


def exact_groups(entities: DataFrame) -> DataFrame:
    """(kind, norm, canonical, id): phase 1, ids of a kind with one normal form; names without letters
    or digits are left out. ``canonical`` is the least id by code points."""
    e = entities.filter("id is not null").select("id", "kind", normalise(F.col("id")).alias("norm")).filter("norm <> ''").distinct()
    heads = e.groupBy("kind", "norm").agg(F.min("id").alias("canonical"), F.count(F.lit(1)).alias("n"))
    return e.join(heads.filter("n > 1").drop("n"), ["kind", "norm"]).select("kind", "norm", "canonical", "id")


def classes(entities: DataFrame) -> DataFrame:
    """(kind, norm, id): one representative of each kind and normal form, the least id."""
    e = entities.filter("id is not null").select("id", "kind", normalise(F.col("id")).alias("norm")).filter("norm <> ''")
    return e.groupBy("kind", "norm").agg(F.min("id").alias("id"))


def blocks(reps: DataFrame, phonetic: bool = True, small: int = SMALL_KIND) -> DataFrame:
    """(block, kind, id, norm): kinds of at most ``small`` classes are one block, others have a block
    for each two-character prefix and (``phonetic``) each phonetic key."""
    sizes = reps.groupBy(F.col("kind").alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    r = reps.join(sizes, F.col("kind").eqNullSafe(F.col("_k")))
    keys = [F.concat(F.lit("p:"), F.substring("norm", 1, 2))] + ([F.concat(F.lit("m:"), phonetic_key(F.col("id")))] if phonetic else [])
    return r.select("kind", "id", "norm", F.explode(F.when(F.col("_n") <= small, F.array(F.lit("*"))).otherwise(F.array(*keys))).alias("block"))


def _cells(blocked: DataFrame, cell: int) -> DataFrame:
    """``blocked`` with ``_c``, the cells of its block, and ``_i``, its own one. Blocks that make no pair are left out:
    those of one member, and of a phonetic key all members of which have one prefix."""
    prefix = F.substring("norm", 1, 2)
    sizes = (
        blocked.groupBy(F.col("kind").alias("_k"), F.col("block").alias("_b"))
        .agg(F.count(F.lit(1)).alias("_n"), F.ceil(F.count(F.lit(1)) / cell).alias("_c"), (F.min(prefix) != F.max(prefix)).alias("_mixed"))
        .filter((F.col("_n") > 1) & (F.col("_mixed") | ~F.col("_b").startswith("m:")))
    )
    b = blocked.join(sizes, F.col("kind").eqNullSafe(F.col("_k")) & (F.col("block") == F.col("_b"))).select("kind", "block", "id", "norm", "_c", "_n")
    return b.withColumn("_i", F.pmod(F.xxhash64("id"), F.col("_c")))


def _tasks(blocked: DataFrame) -> int:
    """Cells' rows say little about their work: they are spread over so many tasks, which is not reduced by their bytes."""
    return 4 * max(shuffle_partitions(blocked.sparkSession), blocked.sparkSession.sparkContext.defaultParallelism)


def candidate_pairs(blocked: DataFrame, cell: int = CELL) -> DataFrame:
    """(kind, a, b, norm_a, norm_b), a < b: distinct pairs that share a block, made cell by cell."""
    b = _cells(blocked, cell)
    # a member is sent to the cells (i, j) of its row and its column; each pair meets in exactly one
    left = b.select("kind", "block", F.col("id").alias("x"), F.col("norm").alias("nx"), "_i", F.explode(F.sequence(F.col("_i"), F.col("_c") - 1)).alias("_j"))
    right = b.select(
        "kind", "block", F.col("id").alias("y"), F.col("norm").alias("ny"), F.col("_i").alias("_j"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_i"))).alias("_i"),
    )
    # null kinds are equal in a struct; one type on both sides, else the join shuffles once more
    cell_, tasks = F.struct("kind", "block", "_i", "_j").cast("struct<kind:string,block:string,i:bigint,j:bigint>").alias("_cell"), _tasks(blocked)
    left, right = left.select("*", cell_).repartition(tasks, "_cell"), right.select(cell_, "y", "ny").repartition(tasks, "_cell")
    p = left.join(right, "_cell")
    p = p.filter((F.col("_i") < F.col("_j")) | (F.col("x") < F.col("y")))
    # names of one prefix met in its block, so that no pair is made twice and large blocks need no shuffle of pairs
    p = p.filter(~F.col("block").startswith("m:") | (F.substring("nx", 1, 2) != F.substring("ny", 1, 2)))
    swap = F.col("x") > F.col("y")
    return p.select(
        "kind", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(swap, F.col("ny")).otherwise(F.col("nx")).alias("norm_a"),
        F.when(swap, F.col("nx")).otherwise(F.col("ny")).alias("norm_b"),
    )


def _by_value(values: list[str | None], places: np.ndarray) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for i in places:
        if values[i] is not None:
            out.setdefault(values[i], []).append(int(i))
    return out


def _near_in_block(
    block: str | None, cells: list[int], ids: list[str], norms: list[str], short: list[str | None], own: list[bool], floor: float, grid: bool = False,
) -> tuple[list, list, list, list]:
    """Places of both members, similarities and whether one is the other's initials, of the pairs of one block that
    come to ``floor`` or are initialisms; ids are in order. Of two cells only pairs between them, of one its own,
    and of these the pairs whose first member is the task's ``own``. ``grid`` meets names by ``NameGrid``, for floors
    that few pairs come to."""
    sides = sorted(set(cells))
    places = [[i for i, c in enumerate(cells) if c == x] for x in sides]
    meets = [(0, 0)] if len(sides) == 1 else [(0, 1), (1, 0)]
    phonetic = (block or "").startswith("m:")
    left, right, value, initial = [], [], [], []
    for x, y in meets if not grid else ():
        rows, cols = places[x], np.array(places[y], np.int64)
        names = NameColumns([norms[i] for i in cols])
        named: dict[str, list[int]] = {}
        stand: dict[str, list[int]] = {}
        for i in cols:
            named.setdefault(norms[i], []).append(int(i))
            if short[i] is not None:
                stand.setdefault(short[i], []).append(int(i))
        for a in (i for i in rows if own[i]):
            sure = {i for i in [*stand.get(norms[a], ()), *(named.get(short[a], ()) if short[a] is not None else ())] if i > a}
            found, values = set(), []
            for at, v in names.near(norms[a], floor, int(np.searchsorted(cols, a, "right"))):
                to = cols[at]
                left.append(np.full(len(to), a))
                right.append(to)
                value.append(v)
                initial.append(np.isin(to, list(sure)) if sure else np.zeros(len(to), bool))
                if sure:
                    found.update(to.tolist())
            if values := sorted(sure - found):
                left.append(np.full(len(values), a))
                right.append(np.array(values))
                value.append(np.zeros(len(values)))
                initial.append(np.ones(len(values), bool))
    for x, y in meets if grid else ():
        rows, cols = np.array([i for i in places[x] if own[i]], np.int64), np.array(places[y], np.int64)
        starts = np.searchsorted(cols, rows, "right")
        named, stand = _by_value(norms, cols), _by_value(short, cols)
        sure = {(int(a), i) for a in rows for i in [*stand.get(norms[a], ()), *named.get(short[a], ())] if i > a}
        for a, b, v in NameGrid([norms[i] for i in rows], [norms[i] for i in cols]).near(starts, floor):
            a, b = rows[a], cols[b]
            known = [pair in sure for pair in zip(a.tolist(), b.tolist(), strict=True)] if sure else [False] * len(a)
            left.append(a)
            right.append(b)
            value.append(v)
            initial.append(np.array(known, bool))
            sure -= {(int(i), int(j)) for i, j, k in zip(a, b, known, strict=True) if k} if any(known) else set()
        if sure:
            left.append(np.array([a for a, _ in sorted(sure)], np.int64))
            right.append(np.array([b for _, b in sorted(sure)], np.int64))
            value.append(np.zeros(len(sure)))
            initial.append(np.ones(len(sure), bool))
    out = [np.concatenate(x) if x else np.zeros(0, t) for x, t in ((left, np.int64), (right, np.int64), (value, float), (initial, bool))]
    if phonetic and len(out[0]):  # names of one prefix met in its block
        heads = np.array([x[:2] for x in norms])
        out = [x[heads[out[0]] != heads[out[1]]] for x in (out[0], out[1], out[2], out[3])]
    return out


def near_pairs(blocked: DataFrame, floor: float, cell: int | None = None, links: bool = False) -> DataFrame:
    """(kind, a, b, jw, short): of ``candidate_pairs`` those whose Jaro-Winkler similarity is at least ``floor`` or
    one of which is the other's initials (``short``; ``jw`` is 0 where it is under the floor). Pairs are compared where their cells
    meet, and only those that are kept become rows. With ``links`` a task keeps no more of them than join the groups that all
    its pairs join, the best first: every member's best pair is among them."""
    b = _cells(blocked, cell or (LINK_CELL if links else NEAR_CELL)).withColumn("_s", initials(F.col("id")))
    j = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_c") - 1)).alias("_j")
    hashed = F.xxhash64("kind", "block")
    shares = F.ceil(F.col("_n") / F.col("_c") / LINK_ROWS) if links else F.when(F.col("_c") > 1, CELL_SHARES).otherwise(1).cast("long")
    b = b.select("kind", "block", "id", "norm", "_s", "_i", "_c", shares.alias("_p"), j).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_p") - 1)).alias("_t"))
    own = F.pmod(F.xxhash64("id", F.lit(1)), F.col("_p")) == F.col("_t")
    b = b.select(
        "kind", "block", "id", "norm", "_s", "_t", own.alias("_own"), F.col("_i").alias("_cell"), F.when((F.col("_c") > 1) | (F.col("_p") > 1), hashed).otherwise(F.pmod(hashed, F.lit(BLOCK_GROUPS))).alias("_g"),
        F.least("_i", "_j").alias("_x"), F.greatest("_i", "_j").alias("_y"),
    )
    kind = pa.string()

    def near(t: pa.Table) -> pa.Table:
        kinds, blocks_, ids, norms, short, cells, own = (t.column(c).to_pylist() for c in ("kind", "block", "id", "norm", "_s", "_cell", "_own"))
        x, y = t.column("_x")[0].as_py(), t.column("_y")[0].as_py()
        order = sorted(range(len(ids)), key=lambda i: (kinds[i] is not None, kinds[i] or "", blocks_[i], ids[i]))
        left, right, value, initial = [], [], [], []
        for (_, block), run in groupby(order, key=lambda i: (kinds[i], blocks_[i])):
            run = list(run)
            if x != y and len({cells[i] for i in run}) < 2:
                continue  # one of the two cells is empty
            a, b_, v, s = _near_in_block(block, [cells[i] for i in run], [ids[i] for i in run], [norms[i] for i in run], [short[i] for i in run], [own[i] for i in run], floor, links)
            at = np.array(run, np.int64)
            left.append(at[a])
            right.append(at[b_])
            value.append(v)
            initial.append(s)
        if not left:
            left, right, value, initial = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, bool)]
        left, right, value, initial = (np.concatenate(x) for x in (left, right, value, initial))
        id_ = t.column("id").combine_chunks()
        if links:
            best = np.lexsort((~initial, -np.where(initial, SHORT_SCORE, value)))
            member = id_.dictionary_encode().indices.to_numpy()
            best = best[spanning_links(len(ids), member[left[best]], member[right[best]])]
            left, right, value, initial = left[best], right[best], value[best], initial[best]
        return pa.table({
            "kind": t.column("kind").combine_chunks().cast(kind).take(pa.array(left)), "a": id_.take(pa.array(left)), "b": id_.take(pa.array(right)),
            "jw": pa.array(value), "short": pa.array(initial),
        })

    return b.repartition(_tasks(blocked), "_g", "_x", "_y", "_t").groupBy("_g", "_x", "_y", "_t").applyInArrow(near, "kind string, a string, b string, jw double, short boolean")


def score(pairs: DataFrame, threshold: float = AUTO_MERGE, cosine: Column | None = None) -> DataFrame:
    """``pairs`` with score, method and band ('auto', 'flagged', 'none').

    Equal forms 1.0, initialisms ``SHORT_SCORE``, else Jaro-Winkler of the normal forms, mixed with ``cosine``
    where there is one. A threshold under 0.85 has no effect.
    """
    exact, short = F.col("norm_a") == F.col("norm_b"), initialism(F.col("a"), F.col("b"))
    return _banded(pairs.withColumn("_jw", jaro_winkler("norm_a", "norm_b")), exact, short, threshold, cosine).drop("_jw")


def _banded(p: DataFrame, exact: Column, short: Column, threshold: float, cosine: Column | None) -> DataFrame:
    auto = max(AUTO_MERGE, threshold)
    combined = F.col("_jw") if cosine is None else F.col("_jw") * STRING_WEIGHT + cosine * (1 - STRING_WEIGHT)
    sure = F.lit(True) if cosine is None else cosine >= SEMANTIC_FLOOR
    p = (
        p.withColumn("score", F.when(exact, 1.0).when(short, 0.97).otherwise(combined))
        .withColumn("method", F.when(exact, "exact_normalised").when(short, "initialism").otherwise("jaro_winkler" if cosine is None else "string_embedding"))
    )
    merges = exact | short | ((F.col("score") >= auto) & sure)
    return p.withColumn("band", F.when(merges, "auto").when(F.col("score") >= FLAG_FLOOR, "flagged").otherwise("none"))


def _certain() -> Column:
    return (F.col("norm_a") == F.col("norm_b")) | initialism(F.col("a"), F.col("b"))


def _promising(pairs: DataFrame, floor: float) -> DataFrame:
    """The pairs that can come to ``floor``, those certain without it included."""
    return pairs.filter(_certain() | may_reach(F.col("norm_a"), F.col("norm_b"), floor))


def with_cosine(pairs: DataFrame, reps: DataFrame, encoder) -> DataFrame:
    """``pairs`` with ``cos``, the cosine of the encoder's vectors of the two ids. Pairs that no cosine can
    bring to the flag floor are left out before vectors travel: a cosine adds 1 - STRING_WEIGHT at most."""
    least = (FLAG_FLOOR - (1 - STRING_WEIGHT)) / STRING_WEIGHT
    near = _promising(pairs, least).filter(_certain() | (jaro_winkler("norm_a", "norm_b") >= least))
    v = materialise(encode(reps.select("id").distinct(), "id", encoder), "names")
    both = near.join(v.select(F.col("id").alias("a"), F.col("vec").alias("_va")), "a").join(v.select(F.col("id").alias("b"), F.col("vec").alias("_vb")), "b")
    dot = F.aggregate(F.zip_with("_va", "_vb", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return both.withColumn("cos", dot).drop("_va", "_vb")


def _near_matches(blocked: DataFrame, threshold: float, floor: float, links: bool = False) -> DataFrame:
    """Scored pairs of ``blocked`` without an encoder that come to ``floor``, or the ``links`` among them."""
    near = near_pairs(blocked, floor, links=links).withColumnRenamed("jw", "_jw")  # representatives of a kind have different normal forms
    return _banded(near, F.lit(False), F.col("short"), threshold, None).filter("band <> 'none'").drop("_jw", "short")


def matches(entities: DataFrame, threshold: float = AUTO_MERGE, phonetic: bool = True, encoder=None, small: int = SMALL_KIND) -> DataFrame:
    """Phase 2: scored candidate pairs of class representatives, only those flagged or better. With an
    ``encoder`` (unit vectors), string similarity is mixed with the cosine of the names' vectors."""
    reps = classes(entities)
    if encoder is None:
        return _near_matches(materialise(blocks(reps, phonetic, small), "blocks"), threshold, FLAG_FLOOR)
    reps = materialise(reps, "classes")
    pairs = candidate_pairs(blocks(reps, phonetic, small))
    return score(with_cosine(pairs, reps, encoder), threshold, F.col("cos")).filter("band <> 'none'").drop("cos")


def resolve(
    entities: DataFrame, triples: DataFrame, threshold: float = AUTO_MERGE, phonetic: bool = True, encoder=None, small: int = SMALL_KIND,
) -> dict[str, DataFrame]:
    """All three phases: ``canonical`` (id, canonical), ``aliases`` (alias rows), ``flagged`` pairs.

    The canonical id of a group is its shortest, then least id. Alias rows are a star: each member
    with its canonical id and the best evidence that touches it (lowest phase, highest score).
    """
    if encoder is None:  # flagged pairs are many times those that merge: made where they are asked for, not kept
        blocked = materialise(blocks(classes(entities), phonetic, small), "blocks")
        auto = materialise(_near_matches(blocked, threshold, max(AUTO_MERGE, threshold), links=True).filter("band = 'auto'"), "auto")
        flagged = _near_matches(blocked, threshold, FLAG_FLOOR).filter("band = 'flagged'")
    else:
        scored = materialise(matches(entities, threshold, phonetic, encoder, small), "scored")
        auto, flagged = scored.filter("band = 'auto'"), scored.filter("band = 'flagged'")
    one = (
        exact_groups(entities)
        .filter("id <> canonical")
        .select(F.col("canonical").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("score"), F.lit(1).alias("phase"), F.lit("exact_normalised").alias("method"))
    )
    two = auto.select("a", "b", "score", F.lit(2).alias("phase"), "method")
    three = (
        triples.filter("predicate = 'SIMILAR_TO' and subject is not null and object is not null and subject <> object")
        .select(F.col("subject").alias("a"), F.col("object").alias("b"), F.lit(0.80).alias("score"), F.lit(3).alias("phase"), F.lit("structural_wcc").alias("method"))
        .distinct()
    )
    links = materialise(one.union(two).union(three), "links")
    canonical = materialise(components(links, "a", "b", shortest_first), "canonical").select("id", F.col("root").alias("canonical"))
    touch = (
        links.select(F.explode(F.array("a", "b")).alias("id"), F.struct("phase", (-F.col("score")).alias("worse"), "method").alias("e"))
        .groupBy("id")
        .agg(F.min("e").alias("e"))
    )
    aliases = (
        canonical.filter("id <> canonical")
        .join(touch, "id")
        .select(F.col("canonical").alias("canonical_id"), F.col("id").alias("alias_id"), (-F.col("e.worse")).alias("confidence"), F.col("e.phase").alias("phase"), F.col("e.method").alias("method"))
    )
    return {"canonical": canonical, "aliases": aliases, "flagged": flagged.select("a", "b", "score", "method")}


def same_as_edges(aliases: DataFrame, entities: DataFrame, timestamp: str) -> DataFrame:
    """SAME_AS triples alias -> canonical of alias rows; kinds default to concept, confidence is clamped."""
    kinds = entities.groupBy("id").agg(F.min("kind").alias("kind"))
    a = (
        aliases.join(kinds.select(F.col("id").alias("alias_id"), F.col("kind").alias("sk")), "alias_id", "left")
        .join(kinds.select(F.col("id").alias("canonical_id"), F.col("kind").alias("tk")), "canonical_id", "left")
    )
    concept = F.lit("concept")
    out = a.select(
        F.col("alias_id").alias("subject"), F.lit("SAME_AS").alias("predicate"), F.col("canonical_id").alias("object"), F.coalesce("sk", concept).alias("source_kind"), F.coalesce("tk", concept).alias("target_kind"),
        F.concat(F.lit("entity resolution merge via "), F.coalesce("method", F.lit("null")), F.lit(" (confidence="), F.when(F.col("confidence").isNull(), F.lit("null")).otherwise(F.format_string("%.3f", "confidence")), F.lit(")")).alias("evidence"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence"))).alias("confidence"),
        F.lit("resolution:entity_resolver").alias("source_doc"), F.lit("structural").alias("extraction_method"), F.lit(timestamp).alias("timestamp"), F.lit("entity_resolver").alias("adapter"), F.lit("inferred_relations").alias("layer"), F.lit("EntityResolver").alias("source"),
    )
    return out.withColumn("triple_id", triple_id())


def canonical_map(aliases: DataFrame) -> DataFrame:
    """(id, canonical): every alias followed to the end of its chain, the steps doubling each round.

    Of several rows of an alias the least canonical id holds; null ids and ids linked to themselves do
    not count. Where a chain runs into a loop of aliases, the least id on the loop is canonical.
    """
    step = (
        aliases.filter("alias_id is not null and canonical_id is not null and alias_id <> canonical_id")
        .groupBy(F.col("alias_id").alias("id"))
        .agg(F.min("canonical_id").alias("to"))
    )
    step = materialise(step, "steps")
    live, ended, left = step.select("id", "to", F.lit(True).alias("on")), None, None
    while True:  # only ids still on their way are joined and written again; the others stay to be looked up
        every = live if ended is None else live.union(ended)
        far = every.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("on").alias("on2"))
        now = materialise(live.join(far, "to", "left").select("id", F.coalesce("to2", "to").alias("to"), F.coalesce("on2", F.lit(False)).alias("on")), "chain")
        done, live = now.filter("not on"), now.filter("on")
        ended = done if ended is None else ended.union(done)
        before, left = left, live.count()
        if not left or left == before:  # nobody is on the way any more but those on loops
            break
    ended = ended.select("id", F.col("to").alias("canonical"))
    if not left:
        return ended
    ring = sequence(live.select("id").join(step, "id"), [], ["id"], "id", "rings")
    ring = materialise(ring.select("id", "to", F.col("pos").alias("nid")), "ring")
    number = ring.select(F.col("id").alias("to"), F.col("nid").alias("parent"))
    loops = find_loops(ring.join(number, "to").select("nid", "parent"))
    names = ring.select(F.col("nid").alias("loop"), F.col("id").alias("canonical"))
    return ended.union(loops.join(ring.select("nid", "id"), "nid").join(names, "loop").select("id", "canonical"))


def aliases_of(aliases: DataFrame, canonical: str) -> DataFrame:
    """(alias_id): the aliases written for a canonical id, each once, by code points."""
    return aliases.filter((F.col("canonical_id") == canonical) & F.col("alias_id").isNotNull()).select("alias_id").distinct().orderBy("alias_id")


def new_aliases(existing: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``found`` whose pair of ids is not in ``existing``."""
    return found.join(existing.select("canonical_id", "alias_id"), ["canonical_id", "alias_id"], "left_anti").select(*found.columns)


def alias_stats(aliases: DataFrame) -> DataFrame:
    """Number of alias rows by phase, and in all (phase null)."""
    return aliases.groupBy("phase").agg(F.count(F.lit(1)).alias("n")).union(aliases.agg(F.lit(None).cast("int").alias("phase"), F.count(F.lit(1)).alias("n")))


def pair_quality(labelled: DataFrame, canonical: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of groups over labelled pairs; null labels do not count."""
    c = canonical
    g = (
        labelled.filter("same is not null and id_a is not null and id_b is not null")
        .join(c.select(F.col("id").alias("id_a"), F.col("canonical").alias("ca")), "id_a", "left")
        .join(c.select(F.col("id").alias("id_b"), F.col("canonical").alias("cb")), "id_b", "left")
    )
    said = F.coalesce("ca", "id_a") == F.coalesce("cb", "id_b")
    n = g.agg(*[F.sum(x.cast("long")).alias(a) for x, a in ((F.col("same") & said, "tp"), (~F.col("same") & said, "fp"), (F.col("same") & ~said, "fn"))])
    p, r = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    return n.select(
        "tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(2 * p * r / F.nullif(p + r, F.lit(0.0)), 6).alias("f1"),
    )
