"""Hierarchies, snapshot differences and orphan references against brute force on small tables."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lodestrata.operators import hierarchy as hi
from lodestrata.operators import orphans as orp
from lodestrata.operators import snapshots as sn
from lodestrata.session import join_hot

EDGE = "id long, parent long, name string"


def brute(edges):
    p = {i: q for i, q, _ in edges}
    name = {i: n or "" for i, _, n in edges}
    out = {}
    for i in p:
        path, seen, x = [i], {i}, i
        while True:
            q = p[x]
            if q is None or q not in p:
                ids = path[::-1]
                out[i] = ("ok" if q is None else "broken", x, len(path) - 1, "/".join(name[k] for k in ids))
                break
            if q in seen:
                loop, y = [q], p[q]
                while y != q:
                    loop.append(y)
                    y = p[y]
                out[i] = ("cycle" if i in loop else "below", min(loop), -1, None)
                break
            path.append(q)
            seen.add(q)
            x = q
    return out


def run(spark, edges):
    h = hi.hierarchy(spark.createDataFrame(edges, EDGE))
    path = {r["id"]: r["path"] for r in hi.paths(h).collect()}
    return {r["id"]: (r["state"], r["root"], r["depth"], path[r["id"]] if r["depth"] >= 0 else None) for r in h.collect()}


def test_hierarchy_random(spark):
    rng = random.Random(5)
    ids = rng.sample(range(1, 900), 160)
    edges = [(i, rng.choice([None, *ids, 1000 + k]) if rng.random() < 0.8 else (ids[k - 1] if k else None), None if rng.random() < 0.1 else f"n{i}") for k, i in enumerate(ids)]
    assert run(spark, edges) == brute(edges)


def test_hierarchy_chain_loop_and_intervals(spark):
    edges = [(i, i - 1 if i else None, str(i)) for i in range(70)] + [(100, 100, "self"), (101, 100, "x"), (200, 201, "a"), (201, 200, "b"), (202, 201, "c"), (300, 999, "torn"), (301, 300, "kid")]
    edges += [(400 + i, 35, f"leaf{i}") for i in range(5)]
    assert run(spark, edges) == brute(edges)
    h = hi.hierarchy(spark.createDataFrame(edges, EDGE))
    rows = {r["id"]: r for r in h.where("state <> 'cycle'").collect()}
    below = {(r["id"], r["descendant"]) for r in hi.descendants(h).collect()}
    for a in rows.values():
        inside = {b["id"] for b in rows.values() if b["root"] == a["root"] and a["pre"] <= b["pre"] < a["pre"] + a["size"]} - {a["id"]}
        assert inside == {d for x, d in below if x == a["id"]}
        assert len(inside) == a["size"] - 1


def test_descendants_of_loops_and_below(spark):
    rng = random.Random(8)
    ids = rng.sample(range(1, 2000), 700)
    up = {i: ids[(k + 1) % 5] if k < 5 else ids[5] if k == 5 else rng.choice([*ids[:k], None] if k < 300 else ids[max(0, k - 3):k]) for k, i in enumerate(ids)}
    want, paths = set(), {}
    for i in ids:
        seen, x, k = {i}, up[i], 1
        while x is not None and x not in seen:
            want.add((x, i, k))
            seen.add(x)
            x, k = up[x], k + 1
    members = {x for x in ids[:6]}
    for i in ids:
        p, x = [f"n{i}"], i
        while x not in members and up[x] is not None:
            x = up[x]
            p.append(f"n{x}")
        paths[i] = "/".join(p[::-1])
    h = hi.hierarchy(spark.createDataFrame([(i, up[i], f"n{i}") for i in ids], EDGE)).cache()
    rows = [tuple(r) for r in hi.descendants(h).select("id", "descendant", "distance").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert {r["id"]: r["path"] for r in hi.paths(h).collect()} == paths
    counts = {i: 0 for i in ids}
    for a, _, _ in want:
        counts[a] += 1
    assert {r["id"]: r["size"] - 1 for r in h.collect()} == counts
    assert {r["state"] for r in h.collect()} == {"ok", "cycle", "below"}
    h.unpersist()


def test_hierarchy_empty_and_repeated(spark):
    assert hi.hierarchy(spark.createDataFrame([], EDGE)).count() == 0
    t = dt.datetime(2024, 1, 1)
    raw = spark.createDataFrame([(1, None, "a", t, "x"), (1, None, "a", t, "x"), (2, 9, "old", t, "x"), (2, 1, "new", t + dt.timedelta(days=1), "x"), (None, 1, "z", t, "x")], "k long, up long, nm string, at timestamp, state string")
    h = hi.hierarchy(hi.clean_edges(raw, "k", "up", "nm", "at"))
    assert {r["id"]: r["state"] for r in h.collect()} == {1: "ok", 2: "ok"}
    assert {r["id"]: r["path"] for r in hi.paths(h).collect()} == {1: "a", 2: "a/new"}
    assert hi.paths(hi.hierarchy(spark.createDataFrame([], EDGE))).count() == 0


def test_hierarchy_of_a_long_chain_and_a_broad_parent(spark):
    """200,000 nodes in one chain and 50,000 children of one node; the chain's labels need no array."""
    n, m = 200_000, 50_000
    e = spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit("a").alias("name"))
    e = e.unionByName(spark.range(n, n + m).select("id", F.lit(777).cast("long").alias("parent"), F.lit("b").alias("name")))
    h = hi.hierarchy(e)
    bad = h.where((F.col("root") != 0) | (F.col("depth") != F.when(F.col("id") < n, F.col("id")).otherwise(778)) | (F.col("size") != F.when(F.col("id") >= n, 1).otherwise(n - F.col("id") + F.when(F.col("id") <= 777, m).otherwise(0))))
    assert h.count() == n + m and bad.count() == 0 and h.select("pre").distinct().count() == n + m


def test_join_hot_equals_join(spark):
    left = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 17 == 0, F.lit(None)).otherwise(F.col("id") % 100).alias("k"), "id")
    right = spark.range(100).select(F.col("id").alias("r"), (F.col("id") * 2).alias("v"))
    for how in ("left", "inner"):
        a = join_hot(left, right, "k", "r", how)
        assert sorted(map(str, a.collect())) == sorted(map(str, left.join(right, left["k"] == right["r"], how).collect()))


SN = "snapshot_id long, kind string, qualified string, params int, name string, signature string, type string, path string, line int, exported boolean, callers int, later string"
KEY, VAL = ["kind", "qualified", "params"], ["signature", "type", "path", "exported"]


def changes(spark, rows, snaps):
    df = sn.symbol_rows(spark.createDataFrame(rows, SN))
    pairs = sn.consecutive(spark.createDataFrame(snaps, "snapshot_id long, codebase_id long, taken_at timestamp"))
    return sorted(tuple(r) for r in sn.snapshot_changes(df, pairs, KEY, VAL).collect())


def row(s, q, sig="a()", typ="int", path="p", line=1, k="m", params=0):
    return (s, k, q, params, q, sig, typ, path, line, True, 0, "clash")


def test_snapshot_cases(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    rows = [row(1, "same"), row(2, "same", sig=" a( )", path=".\\p", line=9), row(1, "gone"), row(2, "new"), row(1, "chg"), row(2, "chg", sig="b()"), row(1, "two"), row(1, "two", path="q"), row(2, "two"), row(2, "two"), row(1, "nul", typ=None), row(2, "nul", typ=""), row(5, "other")]
    snaps = [(1, 1, t(2)), (2, 1, t(3)), (2, 1, t(3)), (5, 2, t(1)), (6, 2, t(9))]
    assert changes(spark, rows, snaps) == [(2, "m", "chg", 0, "changed"), (2, "m", "gone", 0, "removed"), (2, "m", "new", 0, "added"), (2, "m", "nul", 0, "changed"), (2, "m", "two", 0, "changed"), (6, "m", "other", 0, "removed")]
    assert changes(spark, [], snaps) == []


def test_snapshot_random(spark):
    rng = random.Random(2)
    rows = [row(s, f"q{rng.randrange(400)}", sig=rng.choice("ab"), params=rng.randrange(2)) for s in (1, 2, 3) for _ in range(700)]
    val = {}
    for r in rows:
        val.setdefault((r[0], r[2], r[3]), set()).add(r[5])
    want = []
    for a, b in ((1, 2), (2, 3)):
        for q, p in {(k[1], k[2]) for k in val if k[0] in (a, b)}:
            x, y = val.get((a, q, p)), val.get((b, q, p))
            if x != y:
                want.append((b, "m", q, p, "added" if x is None else "removed" if y is None else "changed"))
    assert changes(spark, rows, [(i, 1, dt.datetime(2024, 1, i)) for i in (1, 2, 3)]) == sorted(want)


def test_orphans_state_is_incremental(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    ka = "key long, at timestamp_ntz"
    loads = spark.createDataFrame([(1, t(5)), (2, t(5)), (2, t(9)), (3, t(5)), (4, t(20)), (6, None)], ka)
    rem = spark.createDataFrame([(2, t(7)), (3, t(7)), (5, t(1)), (3, t(7))], ka)
    refs = spark.createDataFrame([("code_symbols", k, "code_refs", "target_id", str(i), a) for i, (k, a) in enumerate([(1, t(6)), (2, t(6)), (3, t(6)), (4, t(6)), (5, t(6)), (9, t(6)), (0, t(6)), (None, t(6)), (6, t(6)), (4, t(21)), (4, None)])] + [("code_symbols", 4, "code_refs", "target_id", "3", t(30))], "tbl string, key long, src_table string, src_field string, record_key string, at timestamp_ntz")
    r = refs.select("key", "at")
    full = orp.merge(orp.deltas("code_symbols", loads=loads, removals=rem, refs=r))
    a = orp.merge(orp.deltas("code_symbols", loads=loads.where("key < 3"), refs=r.where("key > 3")))
    b = orp.merge(a, orp.deltas("code_symbols", loads=loads.where("key >= 3"), removals=rem, refs=r.where("key <= 3")))
    assert sorted(map(str, full.collect())) == sorted(map(str, b.collect()))
    got = {(x["record_key"], x["reason"]) for x in orp.orphan_references(refs, full, ("code_symbols", "documents")).collect()}
    assert got == {("2", "deleted"), ("3", "late"), ("4", "deleted"), ("5", "missing")}
