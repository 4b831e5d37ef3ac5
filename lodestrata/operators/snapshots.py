"""What changed between consecutive full snapshots, by Merkle trees over hash ranges of the key.

Rows are reduced to two 64-bit hashes, repeated rows are dropped, and each snapshot's hash ranges get digests. Inner
digests hash the ordered digests of at most ``FANOUT`` children. Consecutive snapshots are compared from the root down;
only ranges below differing digests are followed, and only rows in differing leaves are read again and diffed exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Stages

FANOUT = 16
LEAF_ROWS = 64  # aimed at in the largest snapshot; decides how deep the trees are


def _plain(c: str) -> Column:
    """A column as text in which null and the empty string differ."""
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))


def _hashes(cols: list[str], seed: str) -> Column:
    return F.xxhash64(F.lit(seed), *[_plain(c) for c in cols])


def consecutive(snapshots: DataFrame) -> DataFrame:
    """(earlier, later) by ``taken_at``, on ties by id, within a codebase. Repeated rows count once, the earliest time
    holds; snapshots without id or time are left out."""
    s = snapshots.where("snapshot_id is not null and taken_at is not null").groupBy("codebase_id", "snapshot_id").agg(F.min("taken_at").alias("taken_at"))
    w = Window.partitionBy("codebase_id").orderBy("taken_at", "snapshot_id")
    return s.select(F.lag("snapshot_id").over(w).alias("earlier"), F.col("snapshot_id").alias("later")).where("earlier is not null")


def snapshot_changes(rows: DataFrame, pairs: DataFrame, key: list[str], value: list[str], snapshot: str = "snapshot_id") -> DataFrame:
    """(later, *key, change_kind) over ``pairs`` (earlier, later).

    A key's value is the set of distinct ``value`` tuples it has in a snapshot: ``added`` and ``removed`` keys are in
    one snapshot only, ``changed`` keys have differing sets. Nulls equal each other and differ from empty strings. A
    snapshot without rows is an empty table. Columns of ``rows`` besides those named are not read.
    """
    spark = rows.sparkSession
    st = Stages(spark, "snapshots")
    pairs = st.put(pairs.select("earlier", "later").distinct())
    rows = rows.select(F.col(snapshot).alias("_snap"), *key, *value)
    wanted = pairs.select(F.explode(F.array("earlier", "later")).alias("_w")).distinct()
    rows = rows.join(wanted, F.col("_snap") == F.col("_w"), "left_semi")
    h = st.put(rows.select("_snap", _hashes(key, "k").alias("kh"), _hashes(key + value, "a").alias("a"), _hashes(key + value, "b").alias("b")).distinct())
    most = h.groupBy("_snap").count().agg(F.max("count")).first()[0] or 0
    depth = max(1, min(7, math.ceil(math.log(max(most / LEAF_ROWS, 2), FANOUT))))
    bits = 4 * depth
    leaf = F.shiftrightunsigned("kh", 64 - bits)
    level = h.groupBy("_snap", leaf.alias("node")).agg(F.bit_xor("a").alias("d1"), F.bit_xor("b").alias("d2"), F.count(F.lit(1)).alias("n"))
    levels = [st.put(level.select("_snap", "node", F.xxhash64("d1", "n").alias("d1"), F.xxhash64("d2", "n").alias("d2")))]
    for _ in range(depth):  # each inner node hashes its ordered children, FANOUT at most
        kids = F.array_sort(F.collect_list(F.struct("node", "d1", "d2")))
        up = levels[-1].groupBy("_snap", F.shiftrightunsigned("node", 4).alias("up")).agg(kids.alias("kids"))
        levels.append(st.put(up.select("_snap", F.col("up").alias("node"), F.xxhash64(F.lit(1), "kids").alias("d1"), F.xxhash64(F.lit(2), "kids").alias("d2"))))

    def sides(of: DataFrame, open_pairs: DataFrame, on_parent: bool) -> DataFrame:
        """Digests of both snapshots of the open pairs, and of the open parent nodes only."""
        cond = (F.shiftrightunsigned("node", 4) == F.col("o_node")) if on_parent else F.lit(True)
        a = of.join(open_pairs, (F.col("_snap") == F.col("earlier")) & cond).select("earlier", "later", "node", F.struct("d1", "d2").alias("x"), F.lit(0).alias("side"))
        b = of.join(open_pairs, (F.col("_snap") == F.col("later")) & cond).select("earlier", "later", "node", F.struct("d1", "d2").alias("x"), F.lit(1).alias("side"))
        u = a.unionByName(b).groupBy("earlier", "later", "node").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        return u.where("n < 2 or lo != hi").select("earlier", "later", F.col("node").alias("o_node"))

    opened = pairs
    for i in range(depth, -1, -1):
        opened = st.put(sides(levels[i], opened, i < depth))
    # only rows of differing leaves
    kh = F.shiftrightunsigned(_hashes(key, "k"), 64 - bits)
    x = rows.withColumn("_leaf", kh)
    o = opened
    a = x.join(o, (F.col("_snap") == F.col("earlier")) & (F.col("_leaf") == F.col("o_node"))).select("later", *key, *value, F.lit(1).alias("old"), F.lit(0).alias("new"))
    b = x.join(o, (F.col("_snap") == F.col("later")) & (F.col("_leaf") == F.col("o_node"))).select("later", *key, *value, F.lit(0).alias("old"), F.lit(1).alias("new"))
    per_value = a.unionByName(b).groupBy("later", *key, *value).agg(F.max("old").alias("old"), F.max("new").alias("new"))
    per_key = per_value.groupBy("later", *key).agg(F.max("old").alias("had"), F.max("new").alias("has"), F.max((F.col("old") != F.col("new")).cast("int")).alias("differs"))
    kind = F.when(F.col("had") == 0, "added").when(F.col("has") == 0, "removed").when(F.col("differs") == 1, "changed")
    return per_key.withColumn("change_kind", kind).where("change_kind is not null").select("later", *key, "change_kind")


def symbol_rows(df: DataFrame) -> DataFrame:
    """Snapshot symbols as they are compared: no white space in signature and type, one way of writing paths."""
    return df.select(
        "snapshot_id", "kind", "qualified", "params",
        F.regexp_replace("signature", r"(?U)\s+", "").alias("signature"),
        F.regexp_replace("type", r"(?U)\s+", "").alias("type"),
        F.regexp_replace(F.regexp_replace("path", r"\\", "/"), r"^(\./+)+", "").alias("path"),
        "exported",
    )
