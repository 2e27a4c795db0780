import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tripleloom.operators.hierarchy import descendants, hierarchy, hierarchy_found, list_rank
from tripleloom.operators.history import attribute_history, history_found
from tripleloom.operators.orphans import orphan_report

TRIPLE = "row_id long, subject string, predicate string, object string, timestamp string, valid_from string, valid_to string, object_is_literal boolean, pos int, _pid string"


def triples(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], TRIPLE)


def iso(minutes):
    return (datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(minutes=minutes)).isoformat()


def brute_history(rows):
    out, groups = [], {}
    for row_id, s, p, o, ts, vf, vt, _ in rows:
        t = lambda x: None if x is None else datetime.fromisoformat(x).astimezone(timezone.utc)
        start, seen, until = t(vf) or t(ts), t(ts), t(vt)
        if start is None or p != "HAS_STATUS":
            continue
        key = (seen is not None, seen or datetime.min.replace(tzinfo=timezone.utc), row_id)
        g = groups.setdefault(s, {})
        if start not in g or key > g[start][0]:
            g[start] = (key, " ".join(o.lower().split()) if o is not None else None, until if until and until > start else None)
    fmt = lambda x: x.strftime("%Y-%m-%dT%H:%M:%SZ")
    for s, g in groups.items():
        seq = sorted((k, v[1], v[2]) for k, v in g.items())
        versions = []
        for i, (start, value, until) in enumerate(seq):
            if i == 0 or seq[i - 1][1] != value or (seq[i - 1][2] and seq[i - 1][2] <= start):
                versions.append([start, None])
            versions[-1][1] = (until, seq[i + 1][0] if i + 1 < len(seq) else None)
        for a, (until, nxt) in versions:
            ends = [x for x in (until, nxt) if x]
            out.append((s, "HAS_STATUS", fmt(a), fmt(min(ends)) if ends else "9999-12-31T00:00:00Z"))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_history_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        start = rng.randrange(300)
        rows.append((i, rng.choice(["hot", "hot", "hot", "b", "c"]), "HAS_STATUS", rng.choice(["On  hold", "on hold", "Done", " done ", "x"]), iso(rng.randrange(500)), rng.choice([None, iso(start)]), rng.choice([None, None, iso(start + rng.randrange(-5, 20))]), True))
    got = [tuple(r) for r in history_found(triples(spark, rows)).collect()]
    assert sorted(got, key=str) == brute_history(rows)


def test_history_runs_longer_than_a_word(spark):
    rows = [(i, "s", "ACHIEVES", "same" if i < 200 else "other", iso(i), None, None, True) for i in range(260)]
    got = attribute_history(triples(spark, rows)).orderBy("version_from").collect()
    assert [(r["value"]) for r in got] == ["same", "other"] and got[0]["version_to"] == got[1]["version_from"]


def test_history_edge_cases(spark):
    rows = [(1, None, "HAS_STATUS", None, iso(0), None, None, None), (2, "s", "HAS_STATUS", None, None, None, None, None), (3, "s", "HAS_STATUS", "x" * 100000, "nonsense", None, None, True), (4, "s", "has_status", "x", iso(1), None, None, True)]
    assert [tuple(r) for r in history_found(triples(spark, rows)).collect()] == [(None, "HAS_STATUS", "2024-01-01T00:00:00Z", "9999-12-31T00:00:00Z")]
    assert history_found(triples(spark, [])).collect() == []


def ts(day):
    return datetime(2024, 1, 1) + timedelta(days=day)


def test_orphans(spark):
    ents = spark.createDataFrame([("A-1", "k", ts(0), None, 1), ("a 1", "k", ts(40), ts(35), 1), ("late", "k", ts(100), None, 1), ("dead", "k", ts(0), ts(1), 1), (None, "k", ts(0), None, 1), ("dead", "k", ts(0), ts(2), 1)], "id string, kind string, created_at timestamp_ntz, deleted_at timestamp_ntz, ref int")
    rows = [(i, s, "P", o, t, None, None, lit) for i, (s, o, t, lit) in enumerate([("a1", "nobody", iso(0), False), ("A_1", "literal", iso(0), True), ("late", "dead", iso(0), None), ("late", "dead", iso(60 * 24 * 70), False), (None, None, iso(0), False), ("ghost", "ghost", "?", False), ("ghost", "ghost", "?", False), ("", "é", iso(0), False), ("É", "zz" * 50000, iso(0), False)])]
    al = spark.createDataFrame([("x", "gone", ts(3)), ("x", None, ts(3)), ("x", "dead", ts(50)), ("x", "a1", ts(60))], "canonical_id string, alias_id string, resolved_at timestamp_ntz")
    com = spark.createDataFrame([("c1", ts(10)), ("c1", ts(200)), ("c2", None)], "community_id string, created_at timestamp_ntz")
    mem = spark.createDataFrame([("c1", "late"), ("c1", "late"), ("c9", "nobody"), (None, "nobody"), ("c2", "late")], "community_id string, entity_id string")
    got = sorted((tuple(r) for r in orphan_report(triples(spark, rows), ents, al, mem, com).collect()), key=str)
    long = "zz" * 50000
    want = [
        ("community_members", "entity_id", "2024-01", "late", "late"), ("community_members", "entity_id", None, "nobody", "missing"),
        ("entity_aliases", "alias_id", "2024-01", "gone", "missing"), ("entity_aliases", "alias_id", "2024-02", "dead", "deleted"), ("entity_aliases", "alias_id", "2024-03", "a1", "deleted"),
        ("triples", "object", "2024-01", "nobody", "missing"), ("triples", "object", "2024-03", "dead", "deleted"), ("triples", "object", None, "ghost", "missing"), ("triples", "object", "2024-01", "é", "missing"), ("triples", "object", "2024-01", long, "missing"),
        ("triples", "subject", "2024-01", "late", "late"), ("triples", "subject", "2024-03", "late", "late"), ("triples", "subject", None, "ghost", "missing"), ("triples", "subject", "2024-01", "", "missing"), ("triples", "subject", "2024-01", "é", "missing"),
    ]
    assert got == sorted(want, key=str)
    none = orphan_report(triples(spark, []), ents.limit(0), al.limit(0), mem.limit(0), com.limit(0))
    assert none.collect() == []


def test_list_rank_with_splicing(spark):
    rng = random.Random(5)
    arcs, want, n = [], {}, 0
    for length in (1, 2, 50, 130):
        ids = list(range(n, n + length))
        rng.shuffle(ids)
        n += length
        w = [rng.choice([1, -1]) for _ in ids]
        for i, x in enumerate(ids):
            arcs.append((x, ids[i + 1] if i + 1 < length else None, w[i]))
            want[x] = (ids[-1], length - 1 - i, sum(w[i:]))
    got = {r["id"]: (r["tail"], r["after"], r["total"]) for r in list_rank(spark.createDataFrame(arcs, "id long, next long, w int"), local_max=20).collect()}
    assert got == want


def brute_hierarchy(parent):
    out = {}
    for v in parent:
        path, at = [v], v
        while parent[at] is not None and parent[at] not in path:
            at = parent[at]
            path.append(at)
        if parent[at] is None:
            out[v] = (path[-1], len(path) - 1, "/".join(reversed(path)))
        else:
            loop = path[path.index(parent[at]) :]
            out[v] = (min(loop), -1, "")
    return out


def test_hierarchy_against_brute_force(spark):
    rng = random.Random(8)
    parent = {"n000": None}
    for i in range(1, 90):
        parent[f"n{i:03d}"] = rng.choice([f"n{i - 1:03d}", "n000", f"n{rng.randrange(i):03d}", None])
    for a, b in [("x1", "x2"), ("x2", "x3"), ("x3", "x1"), ("y", "x2"), ("yy", "y"), ("self", "self")]:
        parent[a] = b
    rows = [(c, f" {p}\t" if p else rng.choice([None, "", "unknown"]), ts(5), 1) for c, p in parent.items()]
    rows += [("n005", "x1", ts(1), 1), ("n005", rows[5][1], ts(5), 1), (None, "n000", ts(9), 1)]
    df = spark.createDataFrame(rows, "community_id string, parent_community_id string, created_at timestamp_ntz, nid int")
    tree = hierarchy(df, "community_id", "parent_community_id", "created_at", local_max=40, chunk=8).cache()
    want = brute_hierarchy(parent)
    assert {r["id"]: (r["root_id"], r["depth"], r["path"]) for r in tree.collect()} == want
    pairs = {(r[0], r[1], r[2]) for r in descendants(tree).collect()}
    assert pairs == {(a, v, len(p.split("/")) - 1 - i) for v, (_, dep, p) in want.items() if dep > 0 for i, a in enumerate(p.split("/")[:-1])}
    counts = {a: sum(1 for x in pairs if x[0] == a) for a in want}
    assert all(r["descendants"] == counts[r["id"]] for r in tree.filter("depth >= 0").collect())


def test_hierarchy_only_loops_and_nothing(spark):
    schema = "community_id string, parent_community_id string, created_at timestamp_ntz"
    assert hierarchy_found(spark.createDataFrame([], schema)).collect() == []
    got = hierarchy_found(spark.createDataFrame([("b", "a", None), ("a", "b", None)], schema)).collect()
    assert sorted(tuple(r) for r in got) == [("a", "a", -1, ""), ("b", "a", -1, "")]
    deep = spark.createDataFrame([(f"d{i:04d}", f"d{i - 1:04d}" if i else None, None) for i in range(300)], schema)
    assert hierarchy_found(deep).agg(F.max("depth")).first()[0] == 299
