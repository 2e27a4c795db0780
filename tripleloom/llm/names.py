"""Variant spellings of names typed by people (problem 3).

Method: merge-and-rematch resolution. Every name becomes a profile: the words that are common in the
table (after undoing abbreviations, nicknames and single typos in them), the rare words, initials.
Profiles with equal words merge at once. Then rounds: profiles enter blocks by their keys, matches
within a block merge, merged profiles hold the union of their spellings and initials, and the
richer profiles, and only these, enter blocking again, until a round merges nothing.

Blocks stay small by construction: a block of the typo key holds spellings that differ from one
string by at most one inserted letter, so it has at most (alphabet x length) members, and each block
gives links to one representative, never all pairs. Names that differ only in formatting are one
profile before blocking, however many there are.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.functions.text import strip
from tripleloom.llm.groups import grid_components
from tripleloom.operators.ordered import sequence
from tripleloom.session import discard, materialise

#: Words that carry no name, and titles.
FILLERS = {"the", "of", "and", "for", "dr", "prof", "mr", "mrs", "ms", "sir"}
GLUED = ["and", "for", "of"]
#: Kinds whose ids are no names.
OTHER_KINDS = ["tag", "url_host", "document", "record"]
#: A word is common if its share of all names is above this by so many standard deviations (of the count):
#: one test at every size, at most (words a name) / COMMON_SHARE words.
COMMON_SHARE, DEVIATIONS = 1 / 3000, 2.8
#: Rows of the table of name forms, which is a setting; more are an error.
FORMS = 100_000
#: Labelled pairs that name forms are learned from, at most; a form needs this many pairs.
LABELLED, SUPPORT = 200_000, 2

_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORD = re.compile(r"[^\W_]+\.?")


def words(name: str) -> list[str]:
    """Lower-case words without accents; an abbreviation keeps its full stop, fillers and a bracketed acronym are gone."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
    plain = _CAMEL.sub(" ", plain)
    inner = re.fullmatch(r"(.*?)\s*\(([^()\s]+)\)\s*", plain, re.S)
    if inner:
        outer = [w.rstrip(".") for w in _WORD.findall(inner[1].lower())]
        if "".join(w[0] for w in outer if w not in FILLERS) == inner[2].lower().replace(".", ""):
            plain = inner[1]
    pieces = _WORD.findall(plain)
    if any(w.islower() or w.istitle() for w in pieces):  # "Name AB": initials without stops
        pieces = [x for w in pieces for x in (w if re.fullmatch("[A-Z]{2}", w) else [w])]
    found = [w for w in map(str.lower, pieces) if w.rstrip(".") not in FILLERS]
    if len(found) >= 3 and all(len(w.rstrip(".")) == 1 for w in found):  # N.B.A.F.M.
        return ["".join(w[0] for w in found)]
    return found


def osa_one(a: str, b: str) -> bool:
    """At most one letter inserted, left out, replaced, or two neighbours exchanged."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def deletions(w: str) -> set[str]:
    return {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}


class Lexicon:
    """The common words with their counts, and the forms that stand for other words."""

    def __init__(self, common: dict[str, int], forms: dict[str, str]):
        self.common, self.forms = common, forms
        self.near: dict[str, set[str]] = {}
        for w in set(common) | set(forms) | set(forms.values()):
            if len(w) >= 4:
                for d in deletions(w):
                    self.near.setdefault(d, set()).add(w)
        # a common word a letter away from one four times as common is that word's plural or misspelling
        twins = {w for w in common if len(w) >= 4 and any(common.get(c, 0) >= 4 * common[w] and osa_one(w, c) for d in deletions(w) for c in self.near.get(d, ()) if c != w)}
        self.known = (set(common) - twins) | set(forms.values())
        self.twins = twins - self.known - set(forms)
        self.memo: dict[str, str] = {}

    def word(self, w: str) -> str:
        """The word that ``w`` stands for: itself, a full form, or the one common word a letter away or begun by it."""
        got = self.memo.get(w)
        if got is None:
            got = self.memo[w] = self._word(w)
        return got

    def _word(self, w: str) -> str:
        bare, dotted = w.rstrip("."), w.endswith(".")
        if bare in self.forms:
            return self.forms[bare]
        if bare in self.known and not dotted:
            return bare
        for filler in GLUED:  # words run together: AdaptiveandRelation
            if bare.endswith(filler) and bare[: -len(filler)] in self.known:
                return bare[: -len(filler)]
        if (2 if dotted else 3) <= len(bare) <= 5:  # an abbreviation that no list has: the beginning of one common word
            begun = [c for c in self.known if len(c) > len(bare) + 1 and c.startswith(bare)]
            if len(begun) > 1:
                top = max(self.common.get(c, 0) for c in begun)
                begun = [c for c in begun if self.common.get(c, 0) * 4 >= top]
            if len(begun) == 1 and (dotted or self.common.get(begun[0], 0) > 0):
                return begun[0]
        if len(bare) >= 3:
            close = {c for d in deletions(bare) for c in self.near.get(d, ()) if osa_one(bare, c) and (c in self.known or c in self.forms)}
            full = {self.forms.get(c, c) for c in close}
            if not full and bare not in self.twins:  # a misspelt twin stands for what the twin stands for
                full = {self.word(c) for d in deletions(bare) for c in self.near.get(d, ()) if c in self.twins and osa_one(bare, c)}
            if len(full) == 1:
                return full.pop()
        return bare


def profile(found: list[str], lexicon: Lexicon) -> tuple[str, list[str], str, str]:
    """(rest, rare words, initials, acronym) of one name's words."""
    said = [lexicon.word(w) for w in found]
    common = sorted(w for w in said if w in lexicon.known or re.fullmatch(r"v?\d+", w))
    rare = sorted(w for w in said if len(w) > 1 and w not in lexicon.known and not re.fullmatch(r"v?\d+", w))
    initials = "".join(dict.fromkeys(w for w in said if len(w) == 1 and not w.isdigit()))  # the first stands for the given name
    acronym = ""
    if len(said) >= 3 and all(len(w) > 1 for w in said):
        acronym = "".join(w[0] for w in said)
    return " ".join(common), rare, initials, acronym


def lexicon_of(names: DataFrame, forms: DataFrame, labelled: DataFrame | None) -> Lexicon:
    """``names`` has (id, words). Counts cover all names; only words common by share come to the driver."""
    total = names.count()
    bare = F.rtrim(F.col("w"), F.lit("."))
    counts = (
        names.select(F.explode(F.array_distinct("words")).alias("w"))
        .groupBy(bare.alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .filter((F.length("w") > 1) & ~F.col("w").rlike(r"^v?\d+$"))
    )
    counts = counts.filter(F.col("n") - DEVIATIONS * F.sqrt("n") >= total * COMMON_SHARE)
    common = {r["w"]: r["n"] for r in counts.collect()}  # at most (words a name) / COMMON_SHARE
    known: dict[str, set[str]] = {}
    listed = forms.select("short_form", "full_form").filter("short_form is not null and full_form is not null").distinct().limit(FORMS + 1).collect()
    if len(listed) > FORMS:
        raise ValueError(f"more than {FORMS} name forms")
    for r in listed:
        s, f = words(r["short_form"]), words(r["full_form"])
        if len(s) == len(f) == 1 and s[0].rstrip(".") != f[0]:
            known.setdefault(s[0].rstrip("."), set()).add(f[0].rstrip("."))
    pairs = {s: next(iter(f)) for s, f in known.items() if len(f) == 1}  # a form of several words is left as it stands
    for s in pairs:
        common.pop(s, None)
    for short, full in _learned(names, pairs):
        pairs[short] = full
        common.pop(short, None)
    if labelled is not None:
        draft, votes = Lexicon(common, pairs), {}
        rows = (  # documented bound
            labelled.filter("same and id_a is not null and id_b is not null")
            .select("id_a", "id_b")
            .distinct()
            .orderBy(F.xxhash64("id_a", "id_b"))
            .limit(LABELLED)
            .collect()
        )
        for r in rows:
            a, b = ({draft.word(w) for w in words(r[c]) if len(w.rstrip(".")) > 1} for c in ("id_a", "id_b"))
            x, y = a - b, b - a
            if len(x) == len(y) == 1 and a & b:
                x, y = x.pop(), y.pop()
                for s, f in ((x, y), (y, x)):
                    # a learned form stands for a word of the list or a more common one
                    if f in draft.known and s not in set(pairs.values()) and common.get(s, 0) < common.get(f, 0) and not osa_one(s, f):
                        votes[(s, f)] = votes.get((s, f), 0) + 1
        for s in {s for s, _ in votes}:
            best = sorted(((n, f) for (t, f), n in votes.items() if t == s), reverse=True)
            if best[0][0] >= SUPPORT and (len(best) == 1 or best[0][0] >= 3 * best[1][0]):
                pairs[s] = best[0][1]
                common.pop(s, None)
    return Lexicon(common, pairs)


def _learned(names: DataFrame, pairs: dict[str, str]) -> list[tuple[str, str]]:
    """Forms that the list lacks: short given names that mostly stand beside family names which also
    stand beside one full name of the list. Counted over all names of two words."""
    full = sorted(set(pairs.values()))
    two = (
        names.filter(F.size("words") == 2)
        .select(F.explode(F.array(F.struct(F.col("words")[0].alias("w"), F.col("words")[1].alias("r")), F.struct(F.col("words")[1].alias("w"), F.col("words")[0].alias("r")))).alias("p"))
        .select("p.w", "p.r")
        .distinct()
    )
    short = two.filter((F.length("w") >= 2) & ~F.col("w").isin([*full, *pairs]) & ~F.col("w").contains("."))
    beside = short.join(two.filter(F.col("w").isin(full)).select("r", F.col("w").alias("f")), "r")
    seen = short.groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")
    families = two.select("r").distinct().count()
    usual = two.filter(F.col("w").isin(full)).groupBy(F.col("w").alias("f")).agg(F.count(F.lit(1)).alias("m"))  # a row a full name
    best = beside.groupBy("w", "f").agg(F.count(F.lit(1)).alias("k")).filter("k >= 3").join(seen, "w").join(usual, "f")
    # half of the short name's families have the full name, and five times as many as families in general
    best = best.filter((2 * F.col("k") >= F.col("n")) & (F.col("k") * families >= 5 * F.col("n") * F.col("m"))).drop("m")
    # at most a few words for each full name of the list
    top = best.groupBy("w").agg(F.max(F.struct("k", "f")).alias("b"), F.count(F.lit(1)).alias("m")).filter("m = 1").select("w", "b.f").collect()
    return sorted((r["w"], r["f"]) for r in top if not osa_one(r["w"], r["f"]))


def _typos(members: list[tuple[int, str]]) -> list[tuple[int, int]]:
    """Links (cluster, cluster) of one block of spellings (cluster, word) around a key."""
    links = []
    by_word: dict[str, int] = {}
    for c, w in members:
        if w in by_word:
            links.append((by_word[w], c))
        else:
            by_word[w] = c
    words_ = sorted(by_word)
    root = {w: w for w in words_}

    def find(w: str) -> str:
        while root[w] != w:
            root[w] = root[root[w]]
            w = root[w]
        return w

    for i, a in enumerate(words_):  # distinct spellings one letter around the key: bounded by alphabet and length
        for b in words_[i + 1 :]:
            if find(a) != find(b) and osa_one(a, b):
                root[find(b)] = find(a)
                links.append((by_word[a], by_word[b]))
    return links


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (key, cluster, word) sorted by key -> links."""
    at, members = None, []
    for f in batches:
        links: list[tuple[int, int]] = []
        for key, c, w in zip(f["key"], f["cluster"], f["word"], strict=True):
            if key != at:
                if len(members) > 1:
                    links += _typos(members)
                at, members = key, []
            members.append((c, w))
        yield pd.DataFrame(links, columns=["u", "v"], dtype="int64")
    if len(members) > 1:
        yield pd.DataFrame(_typos(members), columns=["u", "v"], dtype="int64")


def _fuller(keys: DataFrame) -> DataFrame:
    """Links (u, v) of the blocks in which short names ask for a full one: to the only full name of the
    block; where there are several, to the only one that has all further initials (kind I); where there
    is none, to each other. Aggregations by key, so that no block is held anywhere."""
    full, asks = keys.filter("asks = 0"), keys.filter("asks = 1")
    c = F.when(F.col("asks") == 0, F.col("cluster"))
    blocks = (
        keys.groupBy("key")
        .agg(F.min(c).alias("lo"), F.max(c).alias("hi"), F.min("cluster").alias("any"), F.max("asks").alias("asked"))
        .filter("asked = 1")
    )
    sure = blocks.filter("lo is null or lo = hi").select("key", F.coalesce("lo", "any").alias("u"))
    unsure = blocks.filter("lo <> hi and key like 'I|%'").select("key")
    held = full.join(unsure, "key", "left_semi").groupBy("key", F.col("word").alias("has")).agg(F.min("cluster").alias("lo"), F.max("cluster").alias("hi"))
    wanted = asks.filter("word <> ''").join(unsure, "key", "left_semi").select("key", F.col("word").alias("w")).distinct()
    # both sides are sets of letters of one family name and initial, not names
    fits = F.size(F.array_except(F.split("w", ""), F.split("has", ""))) == 0
    one = (
        wanted.join(held, "key")
        .filter(fits)
        .groupBy("key", "w")
        .agg(F.min("lo").alias("u"), F.max("hi").alias("hi"))
        .filter("u = hi")
        .select("key", F.col("w").alias("word"), "u")
    )
    return asks.join(sure, "key").select("u", F.col("cluster").alias("v")).union(asks.join(one, ["key", "word"]).select("u", F.col("cluster").alias("v")))


def _keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Merged profiles (cluster, spellings "rest|rare words|initials|acronym", middles) -> (key, cluster, word, asks).

    The keys are those of the whole profile: each spelling of a word with each of the words beside it, and
    each family name with the given names and all initials that the profile has anywhere.
    """
    for f in frames:
        out: set[tuple[str, int, str, int]] = set()
        for c, spellings, middles in zip(f["cluster"], f["spellings"], f["middles"], strict=True):
            at: dict[tuple[str, int, int], tuple[set[str], set[str]]] = {}
            families, given, further = set(), set(), set("".join(middles))
            asking: list[tuple[str, str]] = []
            for rest, said, initials, acronym in (x.split("|") for x in spellings):
                rare, commons = said.split(), rest.split()
                for i, w in enumerate(rare):
                    kept = at.setdefault((rest, len(rare), i), (set(), set()))
                    kept[0].add(w)
                    if len(rare) + len(commons) >= 3:  # a filler run together with a rare word of a longer name
                        kept[0].update(w.removesuffix(x) for x in GLUED if w.endswith(x) and len(w) - len(x) >= 4)
                    kept[1].add(" ".join(rare[:i] + rare[i + 1 :]))
                if len(rare) == 1 and not commons and initials:
                    asking.append((rare[0], initials))
                    families.add(rare[0])
                    further |= set(initials[1:])
                if len(rare) == 1 and len(commons) == 1 and commons[0].isalpha():
                    families.add(rare[0])
                    given.add(commons[0][0])
                if len(rare) == 1 and not commons and not initials and 3 <= len(rare[0]) <= 8:
                    out.add((f"A|{rare[0]}", c, rare[0], 1))
                if acronym:
                    out.add((f"A|{acronym}", c, "", 0))
            for (rest, _, _), (said, beside) in at.items():
                out |= {(f"F|{d}|{rest}|{others}", c, w, 0) for w in said if len(w) >= 4 for others in beside if rest or others for d in deletions(w)}
            out |= {(f"I|{w}|{g}", c, "".join(sorted(further)), 0) for w in families for g in given}
            if not given:
                out |= {(f"I|{w}|{initials[0]}", c, initials[1:], 1) for w, initials in asking}
        yield pd.DataFrame(sorted(out), columns=["key", "cluster", "word", "asks"])


def name_clusters(entities: DataFrame, forms: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(id, cluster): every name of ``entities`` with a cluster number; names of one cluster mean the same.

    Null and blank ids, ids that begin with doc: or rec:, and ids that only have kinds such as tag and
    host are no names and have no row. Repeated ids have one row. Null kinds count as names.
    """
    kind = F.lower(strip(F.col("kind")))
    ids = (
        entities.filter(F.col("id").isNotNull() & ~F.col("id").rlike("^(doc|rec):"))
        .groupBy("id")
        .agg(F.max(F.coalesce(~kind.isin(OTHER_KINDS), F.lit(True))).alias("name"))
        .filter("name")
        .select("id")
    )

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["words"] = [words(x) for x in f["id"]]
            yield f[f["words"].map(len) > 0]

    parsed = materialise(ids.mapInPandas(parse, "id string, words array<string>"), "words")
    lexicon = parsed.sparkSession.sparkContext.broadcast((lambda x: (x.common, x.forms))(lexicon_of(parsed, forms, labelled)))  # common words and forms only

    def describe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = Lexicon(*lexicon.value)
        for f in frames:
            rows = [profile(w, lex) for w in f["words"]]
            yield pd.DataFrame({"id": f["id"].to_numpy(), "rest": [r[0] for r in rows], "rare": [r[1] for r in rows], "initials": [r[2] for r in rows], "acronym": [r[3] for r in rows]})

    described = materialise(parsed.mapInPandas(describe, "id string, rest string, rare array<string>, initials string, acronym string"), "described")
    # equal words are one profile; middle initials do not tell names apart, but stand for the given name where there is none
    asks = F.when(F.size(F.array_remove(F.split("rest", " "), "")) == 0, F.col("initials")).otherwise(F.lit(""))
    sig = F.concat_ws("|", F.col("rest"), F.array_join("rare", " "), asks)
    described = described.withColumn("sig", sig)
    acronyms = described.filter("acronym <> ''").select("sig", "acronym").distinct()
    profiles = (
        described.groupBy("sig", "rest", "rare")
        .agg(F.max(asks).alias("initials"), F.array_sort(F.collect_set(F.when(asks == "", F.col("initials")))).alias("middles"))
    )
    numbered = materialise(
        sequence(profiles, [], ["sig"], "sig", "profiles").select("sig", "rest", "rare", "initials", "middles", F.col("pos").alias("node")), "nodes",
    )
    spelled = materialise(
        numbered.join(acronyms, "sig", "left").select("node", F.concat_ws("|", "rest", F.array_join("rare", " "), "initials", F.coalesce("acronym", F.lit(""))).alias("spelling"), "middles"),
        "spelled",
    )
    clusters = numbered.select("node", F.col("node").alias("cluster"))
    keys = touched = merged = None
    while True:  # each round that links leaves fewer clusters
        place = clusters if merged is None else clusters.join(merged.select(F.col("root").alias("cluster")).distinct(), "cluster", "left_semi")
        rich = (
            spelled.join(place, "node")
            .groupBy("cluster")
            .agg(F.array_sort(F.collect_set("spelling")).alias("spellings"), F.array_distinct(F.flatten(F.collect_list("middles"))).alias("middles"))
        )
        fresh = materialise(rich.mapInPandas(_keys, "key string, cluster long, word string, asks int"), "keys")
        if merged is None:
            keys = touched = fresh
        else:  # only the profiles that the last round merged enter again, and only the blocks that they enter are looked at
            # written, as the plan of the links reads them in many places and would hold all rounds in each
            before = keys, touched
            keys = materialise(keys.join(merged.select(F.col("x").alias("cluster")), "cluster", "left_anti").unionByName(fresh), "keys")
            touched = materialise(keys.join(fresh.select("key").distinct(), "key", "left_semi"), "touched")
            discard(*before, fresh)
        typo = touched.filter("key like 'F|%'").select("key", "cluster", "word").repartition("key").sortWithinPartitions("key", "cluster", "word")
        links = typo.mapInPandas(_links, "u long, v long").union(_fuller(touched.filter("key not like 'F|%'")))
        found = materialise(links.filter("u <> v").distinct(), "matches")
        if not found.head(1):
            break
        merged = grid_components(found)
        now = clusters.join(merged.select(F.col("x").alias("cluster"), "root"), "cluster", "left")
        clusters = materialise(now.select("node", F.coalesce("root", "cluster").alias("cluster")), "clusters")
    return described.select("id", "sig").join(numbered.select("sig", "node"), "sig").join(clusters, "node").select("id", "cluster")


def name_groups(entities: DataFrame, forms: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(group_id, id): every name once, with the smallest name (by code points) of those that mean the same.
    One row a name, however many belong together; names are those of ``name_clusters``."""
    c = materialise(name_clusters(entities, forms, labelled), "clusters")
    return c.join(c.groupBy("cluster").agg(F.min("id").alias("group_id")), "cluster").select("group_id", "id")


def same_names(entities: DataFrame, forms: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(id_a, id_b), id_a < id_b by code points: each pair of different ids that name the same.

    The pairs are the result asked for, so a cluster of n names has n (n - 1) / 2 rows; they are made
    by an equi-join on the cluster, which the adaptive plan splits where a cluster is large.
    """
    c = materialise(name_clusters(entities, forms, labelled), "clusters")
    several = c.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("cluster")
    m = c.join(several, "cluster", "left_semi")
    return (
        m.select("cluster", F.col("id").alias("id_a"))
        .join(m.select("cluster", F.col("id").alias("id_b")), "cluster")
        .filter("id_a < id_b")
        .select("id_a", "id_b")
    )
