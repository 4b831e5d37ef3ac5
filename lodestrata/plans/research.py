"""Queries of research, completion, renaming and import resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import codegraph as cg
from ..operators import documents as do
from ..operators import research as re_
from .code import CALLS, EXT, R, S, files, refs, syms
from .documents import B, ID, blocks
from .search import KNN, _knn

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"WITH {KNN} SELECT qid, id FROM r WHERE sim >= 0.35 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(sim, 9) DESC, id) <= 6")
def same_topic(spark: SparkSession, d: str) -> DataFrame:
    """At most six rows per query vector above a threshold, nearest first."""
    w = Window.partitionBy("qid").orderBy(F.desc("sim"), "id")
    return _knn(spark, d).where("sim >= 0.35").withColumn("rk", F.row_number().over(w)).where("rk <= 6").select("qid", "id")


@query()
def meaning_search(spark: SparkSession, d: str) -> DataFrame:
    """Passages near two questions by the default embedder, headings left out."""
    q = dict(enumerate(re_.hashed_bag(["Only the supervisor may open the encoder", "The torque value is pending"]), 1))
    b = re_.embed(blocks(spark, d).where("kind <> 'heading' and text is not null").select("block_id", "text"), "text")
    return re_.nearest(b, "block_id", q, floor=0.3, band=0.2).select("qid", F.col("id").alias("block_id"), "rank")


DEFS = f"""WITH {B}, m AS (SELECT doc_id, seq, block_id, unnest(regexp_extract_all(text, '"([^"]{{2,40}})" means ([^.]+\\.)')) AS m FROM b), y AS (SELECT doc_id, seq, block_id, regexp_extract(m, '"([^"]{{2,40}})" means ([^.]+\\.)', 1) AS term, regexp_extract(m, '"([^"]{{2,40}})" means ([^.]+\\.)', 2) AS definition FROM m)"""


@query(DEFS + " SELECT doc_id, term, arg_min(definition, struct_pack(s := seq, b := block_id, d := definition)) AS definition FROM y GROUP BY 1, 2")
def glossary(spark: SparkSession, d: str) -> DataFrame:
    return re_.definitions(blocks(spark, d).where("text is not null"))


@query(DEFS + ", t AS (SELECT DISTINCT doc_id, lower(term) AS term FROM y) SELECT b.block_id, count(*) AS n_terms FROM b JOIN t ON t.doc_id = b.doc_id AND contains(lower(b.text), t.term) GROUP BY 1")
def shared_terms(spark: SparkSession, d: str) -> DataFrame:
    """Passages that use terms their document defines; terms are few per document and are joined on the document."""
    b = blocks(spark, d).where("text is not null")
    t = re_.definitions(b).select("doc_id", F.lower("term").alias("term")).distinct()
    return b.join(t, "doc_id").where(F.contains(F.lower("text"), F.col("term"))).groupBy("block_id").agg(F.count(F.lit(1)).alias("n_terms"))


@query(ID + """, p AS (SELECT DISTINCT doc_id, key FROM o), n AS (SELECT doc_id, lead(doc_id) OVER (ORDER BY doc_id) AS next FROM (SELECT DISTINCT doc_id FROM p)),
 a AS (SELECT n.doc_id AS pair, p.key FROM n JOIN p ON p.doc_id = n.doc_id WHERE next IS NOT NULL), c AS (SELECT n.doc_id AS pair, p.key FROM n JOIN p ON p.doc_id = n.next WHERE next IS NOT NULL)
 SELECT coalesce(a.pair, c.pair) AS pair, CASE WHEN a.key IS NULL THEN 'added' WHEN c.key IS NULL THEN 'removed' ELSE 'kept' END AS state, count(*) AS n FROM a FULL JOIN c ON a.pair = c.pair AND a.key = c.key GROUP BY 1, 2""")
def identifier_changes(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers that came, went and stayed between each document and the next one by id."""
    p = do.identifiers(blocks(spark, d)).select("doc_id", "key").distinct()
    ids = p.select("doc_id").distinct()
    # the next id by a range-bucketed lead: the last id of a bucket looks up the first of the next filled one
    x = ids.withColumn("bk", F.floor(F.col("doc_id") / 100_000))
    w = Window.partitionBy("bk").orderBy("doc_id")
    heads = x.groupBy("bk").agg(F.min("doc_id").alias("first")).withColumn("after", F.lead("first").over(Window.orderBy("bk")))  # one row per 100,000 ids
    n = x.withColumn("nx", F.lead("doc_id").over(w)).join(heads.select("bk", "after"), "bk").select("doc_id", F.coalesce("nx", "after").alias("next")).where("next is not null")
    a = n.join(p, "doc_id").select(F.col("doc_id").alias("pair"), "key", F.lit(1).alias("o"), F.lit(0).alias("w"))
    b = n.select(F.col("doc_id").alias("pair"), F.col("next").alias("doc_id")).join(p, "doc_id").select("pair", "key", F.lit(0).alias("o"), F.lit(1).alias("w"))
    k = a.unionByName(b).groupBy("pair", "key").agg(F.max("o").alias("o"), F.max("w").alias("w"))
    return k.groupBy("pair", F.when(F.col("o") == 0, "added").when(F.col("w") == 0, "removed").otherwise("kept").alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query(rf"""WITH f AS (SELECT DISTINCT ON (file_id) * FROM code_files), {S}, i AS (SELECT DISTINCT file_id, codebase_id, unnest(regexp_extract_all(content, '(?m)^\s*import\s+(?:static\s+)?([\w.]+)\s*;', 1)) AS name FROM f WHERE path LIKE '%.java'),
 t AS (SELECT codebase_id, qualified, min(symbol_id) AS symbol_id FROM s WHERE kind IN ('class', 'interface', 'enum', 'record') GROUP BY 1, 2) SELECT i.file_id, i.name, coalesce(t.symbol_id, -1) AS symbol_id FROM i LEFT JOIN t ON t.codebase_id = i.codebase_id AND t.qualified = i.name""")
def java_imports(spark: SparkSession, d: str) -> DataFrame:
    """Imported names of Java files, linked to the codebase's types by qualified name; -1 is outside."""
    i = files(spark, d).where(F.col("path").endswith(".java")).select("file_id", "codebase_id", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)\s*;"), F.lit(1))).alias("name")).distinct()
    t = syms(spark, d).where(F.col("kind").isin(*cg.TYPE_KINDS)).groupBy("codebase_id", F.col("qualified").alias("name")).agg(F.min("symbol_id").alias("symbol_id"))
    return i.join(t, ["codebase_id", "name"], "left").select("file_id", "name", F.coalesce("symbol_id", F.lit(-1)).alias("symbol_id"))


@query(f"""WITH {S}, {R}, q AS (SELECT symbol_id, codebase_id, name FROM s WHERE symbol_id % 100 = 0 AND regexp_full_match(name, '[A-Za-z_$][A-Za-z0-9_$]*')),
 fw AS (SELECT DISTINCT codebase_id, file_id, unnest(string_split_regex(content, '[^A-Za-z0-9_$]+')) AS w FROM (SELECT DISTINCT codebase_id, file_id, content FROM code_files))
 SELECT q.symbol_id, 'use' AS what, count(*) AS n FROM q JOIN r ON r.target_id = q.symbol_id GROUP BY 1 UNION ALL SELECT q.symbol_id, 'import', count(*) FROM q JOIN r ON r.kind = 'import' AND r.codebase_id = q.codebase_id AND r.name = q.name GROUP BY 1
 UNION ALL SELECT q.symbol_id, 'mention', count(DISTINCT file_id) FROM q JOIN fw ON fw.codebase_id = q.codebase_id AND fw.w = q.name GROUP BY 1
 UNION ALL SELECT q.symbol_id, 'collision', count(*) FROM q JOIN s ON s.codebase_id = q.codebase_id AND s.name = q.name AND s.symbol_id <> q.symbol_id GROUP BY 1""")
def rename_preview(spark: SparkSession, d: str) -> DataFrame:
    """What renaming each symbol whose id is divisible by 100 would touch in its codebase: linked uses, imports of its name,
    files that mention it, and other symbols of that name."""
    s, r = syms(spark, d), refs(spark, d)
    q = s.where(F.col("symbol_id") % 100 == 0).where(F.col("name").rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*$")).select("symbol_id", F.col("codebase_id").alias("cb"), F.col("name").alias("nm"))
    words = files(spark, d).select("codebase_id", "file_id", F.explode(F.array_distinct(F.split("content", r"[^A-Za-z0-9_$]+"))).alias("name")).distinct()
    by_name = lambda x: q.join(x, (F.col("cb") == F.col("codebase_id")) & (F.col("nm") == F.col("name")))
    parts = {
        "use": q.join(r.where("target_id >= 1").select("target_id"), F.col("symbol_id") == F.col("target_id")), "import": by_name(r.where("kind = 'import'").select("codebase_id", "name")),
        "mention": by_name(words), "collision": by_name(s.select("codebase_id", "name", F.col("symbol_id").alias("other"))).where("other <> symbol_id"),
    }
    out = None
    for k, x in parts.items():
        y = x.groupBy("symbol_id").agg(F.count(F.lit(1)).alias("n")).select("symbol_id", F.lit(k).alias("what"), "n")
        out = y if out is None else out.unionByName(y)
    return out


@query("SELECT file_id, len(regexp_extract_all(content, 'repository')) AS n_hits, md5(replace(content, 'repository', 'store')) AS after_md5 FROM (SELECT DISTINCT ON (file_id) * FROM code_files) WHERE contains(content, 'repository')")
def replace_preview(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d).where(F.contains("content", F.lit("repository")))
    return f.select("file_id", F.regexp_count("content", F.lit("repository")).cast("long").alias("n_hits"), F.md5(F.replace("content", F.lit("repository"), F.lit("store"))).alias("after_md5"))


@query(f"""WITH {S}, {R}, u AS (SELECT target_id, count(*) AS n FROM r WHERE target_id >= 1 GROUP BY 1) SELECT s.codebase_id, s.name, count(*) AS n_symbols, coalesce(sum(u.n), 0)::BIGINT AS n_uses FROM s LEFT JOIN u ON u.target_id = s.symbol_id WHERE starts_with(s.name, 'load') AND s.kind IN ('method', 'function') GROUP BY 1, 2
 QUALIFY row_number() OVER (PARTITION BY s.codebase_id ORDER BY n_uses DESC, s.name) <= 20""")
def completion(spark: SparkSession, d: str) -> DataFrame:
    """Members and functions that begin with a prefix, the most used first, 20 per codebase."""
    s = syms(spark, d).where(F.col("name").startswith("load") & F.col("kind").isin("method", "function")).select("symbol_id", "codebase_id", "name")
    u = refs(spark, d).where("target_id >= 1").groupBy("target_id").agg(F.count(F.lit(1)).alias("n"))
    x = s.join(u, F.col("symbol_id") == F.col("target_id"), "left").groupBy("codebase_id", "name").agg(F.count(F.lit(1)).alias("n_symbols"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_uses"))
    w = Window.partitionBy("codebase_id").orderBy(F.desc("n_uses"), "name")
    return x.withColumn("rk", F.row_number().over(w)).where("rk <= 20").drop("rk")


@query(f"""WITH {R}, {CALLS}, e AS (SELECT DISTINCT caller FROM c WHERE caller NOT IN (SELECT callee FROM c)) SELECT a.caller AS entry, count(DISTINCT a.callee) AS n1, count(DISTINCT b.callee) AS n2, count(DISTINCT k.callee) AS n3
 FROM e JOIN c a USING (caller) LEFT JOIN c b ON b.caller = a.callee LEFT JOIN c k ON k.caller = b.callee GROUP BY 1""")
def entry_chains(spark: SparkSession, d: str) -> DataFrame:
    """From every symbol nobody calls, what is reached in one, two and three calls."""
    c = cg.call_edges(refs(spark, d)).select("caller", "callee")
    e = c.select("caller").distinct().join(c.select(F.col("callee").alias("caller")), "caller", "left_anti")
    one = c.join(e, "caller", "left_semi").select(F.col("caller").alias("entry"), F.col("callee").alias("a"))
    step = lambda x, a, b: x.select("entry", a).distinct().join(c.select(F.col("caller").alias(a), F.col("callee").alias(b)), a).select("entry", b).distinct()
    two = step(one, "a", "b")
    three = step(two, "b", "k")
    n = lambda x, k, o: x.groupBy("entry").agg(F.count_distinct(k).alias(o))
    x = n(one, "a", "n1").join(n(two, "b", "n2"), "entry", "left").join(n(three, "k", "n3"), "entry", "left")
    return x.select("entry", "n1", F.coalesce("n2", F.lit(0)).alias("n2"), F.coalesce("n3", F.lit(0)).alias("n3"))


@query(f"""WITH RECURSIVE {S}, {R}, {EXT}, u AS (SELECT sub AS a, sup AS b FROM e UNION SELECT sup, sub FROM e), w AS (SELECT a AS node, a AS x FROM u UNION SELECT w.node, u.b FROM w JOIN u ON u.a = w.x)
 SELECT node, min(x) AS component FROM w GROUP BY 1""")
def type_families(spark: SparkSession, d: str) -> DataFrame:
    """Types connected by extending each other, named by the smallest id: what a rename must keep together."""
    return re_.components(cg.extends_edges(refs(spark, d), syms(spark, d)), "sub", "sup")


@query(f"""WITH {S}, t AS (SELECT codebase_id, symbol_id, regexp_replace(name, '\\d+$', '') AS name FROM s WHERE kind IN ('class', 'interface')), x AS (SELECT *, regexp_extract(name, '([A-Z][a-z]+)$', 1) AS suffix FROM t), n AS (SELECT codebase_id, suffix, count(*) AS n, sum(count(*)) OVER (PARTITION BY codebase_id) AS total FROM x GROUP BY 1, 2)
 SELECT x.symbol_id FROM x JOIN n USING (codebase_id, suffix) WHERE n.n = 1 AND n.total >= 3""")
def naming_outliers(spark: SparkSession, d: str) -> DataFrame:
    """Types whose last name part no other type of the codebase has."""
    t = syms(spark, d).where("kind in ('class', 'interface')").select("codebase_id", "symbol_id", F.regexp_extract(F.regexp_replace("name", r"\d+$", ""), r"([A-Z][a-z]+)$", 1).alias("suffix"))
    n = t.groupBy("codebase_id", "suffix").agg(F.count(F.lit(1)).alias("n"))
    c = t.groupBy("codebase_id").agg(F.count(F.lit(1)).alias("total")).where("total >= 3")
    return t.join(n.where("n = 1"), ["codebase_id", "suffix"]).join(c, "codebase_id").select("symbol_id")


@query()
def parameter_lists(spark: SparkSession, d: str) -> DataFrame:
    """Parameter types read from signatures."""
    s = syms(spark, d).where("params > 0 and signature is not null")
    return s.select("symbol_id", F.array_join(re_.parameter_types_of("signature"), "; ").alias("types"))


@query(f"WITH {R} SELECT ref_id, greatest(0.0, least(1.0, CASE WHEN stmt_end - stmt_start + 1 <= 3 THEN 1.0 WHEN stmt_end - stmt_start + 1 <= 6 THEN 0.7 ELSE 0.4 END - CASE WHEN coalesce(target_id >= 1, false) THEN 0 ELSE 0.3 END))::DOUBLE AS quality FROM r WHERE kind = 'call' AND stmt_start IS NOT NULL")
def example_quality(spark: SparkSession, d: str) -> DataFrame:
    r = refs(spark, d).where("kind = 'call' and stmt_start is not null")
    q = re_.quality(F.col("stmt_end") - F.col("stmt_start") + 1, F.coalesce(F.col("target_id") >= 1, F.lit(False)), F.lit(False))
    return r.select("ref_id", q.cast("double").alias("quality"))
