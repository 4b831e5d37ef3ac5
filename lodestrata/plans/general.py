"""Queries of the general corpus operators (hierarchies, snapshots, orphan references)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy as hi
from ..operators import orphans as orp
from ..operators import snapshots as sn
from ..session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return hi.clean_edges(table(spark, d, "code_symbols"), "symbol_id", "parent_id", "name", "loaded_at")


_TREE = """WITH RECURSIVE n AS (SELECT symbol_id AS id, any_value(parent_id) AS parent FROM code_symbols GROUP BY 1),
 m AS (SELECT a.id, CASE WHEN b.id IS NULL THEN NULL ELSE a.parent END AS parent, a.parent IS NOT NULL AND b.id IS NULL AS torn FROM n a LEFT JOIN n b ON a.parent = b.id),
 t AS (SELECT id, id AS root, 0::BIGINT AS depth, torn FROM m WHERE parent IS NULL
       UNION ALL SELECT m.id, t.root, t.depth + 1, t.torn FROM m JOIN t ON m.parent = t.id),
 c AS (SELECT id, parent FROM m WHERE id NOT IN (SELECT id FROM t)),
 w AS (SELECT id, parent AS x FROM c UNION SELECT w.id, c.parent FROM w JOIN c ON w.x = c.id),
 lo AS (SELECT DISTINCT id FROM w WHERE id = x),
 f AS (SELECT w.id, min(w.x) AS root FROM w JOIN lo ON lo.id = w.x GROUP BY 1)"""


@query(_TREE + """ SELECT id AS symbol_id, root AS root_id, depth AS node_depth, CASE WHEN torn THEN 'broken' ELSE 'ok' END AS node_state FROM t
 UNION ALL SELECT f.id, f.root, -1, CASE WHEN lo.id IS NULL THEN 'below' ELSE 'cycle' END FROM f LEFT JOIN lo ON lo.id = f.id""")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return hi.hierarchy(_edges(spark, d)).select(F.col("id").alias("symbol_id"), F.col("root").alias("root_id"), F.col("depth").alias("node_depth"), F.col("state").alias("node_state"))


@query(_TREE + """, nm AS (SELECT symbol_id AS id, coalesce(any_value(name), '') AS name FROM code_symbols GROUP BY 1),
 up AS (SELECT c.id, c.parent, lo.id IS NOT NULL AS on_loop FROM c LEFT JOIN lo ON lo.id = c.id),
 p AS (SELECT a.id, nm.name AS path FROM m a JOIN nm ON nm.id = a.id WHERE a.parent IS NULL
       UNION ALL SELECT m.id, p.path || '/' || nm.name FROM m JOIN p ON m.parent = p.id JOIN nm ON nm.id = m.id),
 b AS (SELECT up.id, nm.name AS path FROM up JOIN nm ON nm.id = up.id WHERE on_loop
       UNION ALL SELECT up.id, b.path || '/' || nm.name FROM up JOIN b ON up.parent = b.id JOIN nm ON nm.id = up.id WHERE NOT up.on_loop),
 d AS (SELECT id, parent AS up FROM m WHERE parent IS NOT NULL UNION SELECT d.id, m.parent FROM d JOIN m ON m.id = d.up WHERE m.parent IS NOT NULL)
 SELECT q.id AS symbol_id, path AS full_path, coalesce(k, 0) AS n_descendants FROM (SELECT * FROM p UNION ALL SELECT * FROM b) q
 LEFT JOIN (SELECT up, count(*) AS k FROM d WHERE id <> up GROUP BY 1) k ON k.up = q.id""")
def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every symbol; below a loop the path begins at the loop's member."""
    h = hi.hierarchy(_edges(spark, d))
    p = hi.paths(h).select(F.col("id").alias("symbol_id"), F.col("path").alias("full_path"))
    return p.join(h.select(F.col("id").alias("symbol_id"), (F.col("size") - 1).alias("n_descendants")), "symbol_id")


@query(_TREE + """, d AS (SELECT id, parent AS up, 1::BIGINT AS k FROM m WHERE parent IS NOT NULL
       UNION SELECT d.id, m.parent, d.k + 1 FROM d JOIN m ON m.id = d.up WHERE m.parent IS NOT NULL AND m.parent <> d.id AND d.up <> d.id AND d.k <= (SELECT count(*) FROM lo) + (SELECT max(depth) FROM t) + 64)
 SELECT up AS symbol_id, id AS descendant_id, min(k) AS distance FROM d WHERE up <> id GROUP BY 1, 2""")
def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every symbol; a loop's members are below each other."""
    return hi.descendants(hi.hierarchy(_edges(spark, d))).select(F.col("id").alias("symbol_id"), F.col("descendant").alias("descendant_id"), "distance")


@query(r"""WITH s AS (SELECT codebase_id, snapshot_id, min(taken_at) AS taken_at FROM code_snapshots GROUP BY 1, 2),
 p AS (SELECT snapshot_id AS later, lag(snapshot_id) OVER (PARTITION BY codebase_id ORDER BY taken_at, snapshot_id) AS earlier FROM s),
 v AS (SELECT DISTINCT snapshot_id, kind, qualified, params, regexp_replace(signature, '\s+', '', 'g') AS signature, regexp_replace(type, '\s+', '', 'g') AS type,
  regexp_replace(replace(path, '\', '/'), '^(\./+)+', '') AS path, exported FROM code_snapshot_symbols),
 k AS (SELECT snapshot_id, kind, qualified, params, list(row(signature, type, path, exported)::VARCHAR ORDER BY row(signature, type, path, exported)::VARCHAR) AS vs FROM v GROUP BY ALL),
 q AS (SELECT * FROM p WHERE earlier IS NOT NULL),
 o AS (SELECT later, kind, qualified, params, vs FROM q JOIN k ON k.snapshot_id = q.earlier),
 n AS (SELECT later, kind, qualified, params, vs FROM q JOIN k ON k.snapshot_id = q.later)
 SELECT coalesce(o.later, n.later) AS snapshot_id, coalesce(o.kind, n.kind) AS kind, coalesce(o.qualified, n.qualified) AS qualified, coalesce(o.params, n.params) AS params,
  CASE WHEN o.vs IS NULL THEN 'added' WHEN n.vs IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
 FROM o FULL JOIN n ON o.later = n.later AND o.kind IS NOT DISTINCT FROM n.kind AND o.qualified IS NOT DISTINCT FROM n.qualified AND o.params IS NOT DISTINCT FROM n.params
 WHERE o.vs IS DISTINCT FROM n.vs""")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = sn.consecutive(table(spark, d, "code_snapshots"))
    rows = sn.symbol_rows(table(spark, d, "code_snapshot_symbols"))
    out = sn.snapshot_changes(rows, pairs, ["kind", "qualified", "params"], ["signature", "type", "path", "exported"])
    return out.withColumnRenamed("later", "snapshot_id")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    sym = table(spark, d, "code_symbols").select(F.col("symbol_id").alias("key"), F.col("loaded_at").alias("at"))
    doc = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("added_at").alias("at"))
    rem = table(spark, d, "removals").select("src_table", F.col("record_id").alias("key"), F.col("removed_at").alias("at"))
    raw = table(spark, d, "code_refs").select("ref_id", "target_id", "from_symbol", "loaded_at")
    field = lambda c: raw.select(F.lit("code_symbols").alias("tbl"), F.col(c).alias("key"), F.lit("code_refs").alias("src_table"), F.lit(c).alias("src_field"), F.col("ref_id").cast("string").alias("record_key"), F.col("loaded_at").cast(orp.TS).alias("at"))
    pins = table(spark, d, "pins").select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("key"), F.lit("pins").alias("src_table"), F.lit("doc_id").alias("src_field"), F.col("pin_key").alias("record_key"), F.col("added_at").cast(orp.TS).alias("at"))
    refs = field("target_id").unionByName(field("from_symbol")).unionByName(pins)
    of = lambda t: refs.where(F.col("tbl") == t).select("key", "at")
    state = orp.merge(
        orp.deltas("code_symbols", loads=sym, removals=rem.where("src_table = 'code_symbols'"), refs=of("code_symbols")),
        orp.deltas("documents", loads=doc, removals=rem.where("src_table = 'documents'"), refs=of("documents")),
    )
    return orp.orphan_references(refs, state, ("code_symbols", "documents"))


_ORPHANS = """WITH ld AS (SELECT 'code_symbols' AS tbl, symbol_id AS k, min(loaded_at) AS f, max(loaded_at) AS l FROM code_symbols GROUP BY 1, 2
  UNION ALL SELECT 'documents', doc_id, min(added_at), max(added_at) FROM documents GROUP BY 1, 2),
 rm AS (SELECT src_table AS tbl, record_id AS k, max(removed_at) AS r FROM removals GROUP BY 1, 2),
 rf AS (SELECT 'code_symbols' AS tbl, 'code_refs' AS src_table, 'target_id' AS src_field, ref_id::VARCHAR AS record_key, target_id AS k, min(loaded_at) AS t FROM code_refs WHERE target_id >= 1 GROUP BY ALL
  UNION ALL SELECT 'code_symbols', 'code_refs', 'from_symbol', ref_id::VARCHAR, from_symbol, min(loaded_at) FROM code_refs WHERE from_symbol >= 1 GROUP BY ALL
  UNION ALL SELECT 'documents', 'pins', 'doc_id', pin_key, doc_id, min(added_at) FROM pins WHERE doc_id >= 1 GROUP BY ALL),
 o AS (SELECT src_table, src_field, record_key, t, CASE WHEN r > l OR (r IS NOT NULL AND ld.k IS NULL) THEN 'deleted' WHEN ld.k IS NULL THEN 'missing' WHEN f > t THEN 'late' END AS reason
  FROM rf LEFT JOIN ld ON ld.tbl = rf.tbl AND ld.k = rf.k LEFT JOIN rm ON rm.tbl = rf.tbl AND rm.k = rf.k)"""


@query(_ORPHANS + " SELECT DISTINCT src_table, src_field, record_key, reason FROM o WHERE reason IS NOT NULL")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("src_table", "src_field", "record_key", "reason")


@query(_ORPHANS + " SELECT src_table, src_field, strftime(t, '%Y-%m') AS period, reason, count(*) AS n FROM o WHERE reason IS NOT NULL GROUP BY ALL")
def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).groupBy("src_table", "src_field", F.date_format("at", "yyyy-MM").alias("period"), "reason").agg(F.count(F.lit(1)).alias("n"))
