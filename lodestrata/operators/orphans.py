"""References to records that do not exist, from signed counts per key.

Every input is a stream of change deltas (table, key, d_ref, d_exist, first and last load, removal, earliest reference).
Deltas of a key add up in any order and in any batches, so a kept state is brought up to date by merging a batch's
sums into it. Keys with positive references and no existence are orphans; only their references are read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Stages, join_hot

STATE = ["refs", "loads", "first_load", "last_load", "removed_at", "first_ref"]
AGG = {"refs": F.sum, "loads": F.sum, "first_load": F.min, "last_load": F.max, "removed_at": F.max, "first_ref": F.min}
TS = "timestamp_ntz"


def deltas(target: str, *, loads: DataFrame | None = None, removals: DataFrame | None = None, refs: DataFrame | None = None) -> DataFrame:
    """Deltas of one target table. loads and removals and refs: (key, at). Null keys, and reference keys below 1, are none."""
    none = lambda t: F.lit(None).cast(t)
    out = None
    for df, kind in ((loads, "load"), (removals, "removal"), (refs, "ref")):
        if df is None:
            continue
        at = F.col("at").cast(TS)
        d = df.where("key is not null" + (" and key >= 1" if kind == "ref" else "")).select(
            F.lit(target).alias("tbl"), F.col("key").cast("long").alias("key"),
            F.lit(int(kind == "ref")).cast("long").alias("refs"), F.lit(int(kind == "load")).cast("long").alias("loads"),
            (at if kind == "load" else none(TS)).alias("first_load"), (at if kind == "load" else none(TS)).alias("last_load"),
            (at if kind == "removal" else none(TS)).alias("removed_at"), (at if kind == "ref" else none(TS)).alias("first_ref"),
        )
        out = d if out is None else out.unionByName(d)
    return out


def merge(*parts: DataFrame) -> DataFrame:
    """State (tbl, key, counts and times) of states and deltas together; summed before the shuffle."""
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy("tbl", "key").agg(*[AGG[c](c).alias(c) for c in STATE])


def existence(state: DataFrame) -> DataFrame:
    """Adds ``exists`` (1 or 0): loaded, and not removed later than the last load."""
    gone = F.coalesce(F.col("removed_at") > F.col("last_load"), F.lit(False))
    return state.withColumn("exists", F.when((F.col("loads") > 0) & ~gone, 1).otherwise(0))


def suspects(state: DataFrame) -> DataFrame:
    """Keys with positive references that have no existence, or came later than their earliest reference."""
    s = existence(state).where("refs > 0 and (exists = 0 or first_load > first_ref)")
    reason = F.when(F.col("removed_at").isNotNull() & ((F.col("loads") == 0) | (F.col("removed_at") > F.col("last_load"))), "deleted").when(F.col("loads") == 0, "missing").otherwise("late")
    return s.select("tbl", "key", reason.alias("reason"), "first_load")


def orphan_references(refs: DataFrame, state: DataFrame, tables: tuple[str, ...]) -> DataFrame:
    """(src_table, src_field, record_key, reason, at) for refs (tbl, key, src_table, src_field, record_key, at)
    to the given ``tables``.

    A record written again counts once, with its first time. ``deleted``, ``missing`` and ``late`` exclude each other in
    this order. A reference or load without time is never late.
    """
    st = Stages(refs.sparkSession, "orphans")
    bad = st.put(suspects(state))
    one = None
    for tbl in tables:
        b = bad.where(F.col("tbl") == tbl).select(F.col("key").alias("b_key"), "reason", "first_load")
        j = join_hot(refs.where((F.col("tbl") == tbl) & (F.col("key") >= 1)).drop("tbl"), b, "key", "b_key", "inner")
        one = j if one is None else one.unionByName(j)
    g = one.groupBy("src_table", "src_field", "record_key", "key").agg(F.min("at").alias("at"), F.first("reason").alias("reason"), F.first("first_load").alias("first_load"))
    g = g.where((F.col("reason") != "late") | (F.col("first_load") > F.col("at")))
    return g.groupBy("src_table", "src_field", "record_key", "reason").agg(F.min("at").alias("at"))
