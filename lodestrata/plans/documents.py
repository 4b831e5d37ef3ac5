"""Queries over passages, documents and pins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import documents as do
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


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "blocks").dropDuplicates(["block_id"])


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").dropDuplicates(["doc_id"])


B = "b AS (SELECT DISTINCT ON (block_id) * FROM blocks)"
D = "dd AS (SELECT DISTINCT ON (doc_id) * FROM documents)"
PROV = r"CASE WHEN regexp_matches(text, '^\s*(NOTE|EXAMPLE)\b') THEN 'note' WHEN regexp_matches(text, '(?i)\b(shall|must)\b') THEN 'requirement' WHEN regexp_matches(text, '(?i)\bshould\b') THEN 'recommendation' WHEN regexp_matches(text, '\b(may|need not)\b') THEN 'permission' ELSE '' END"


@query(f"WITH {B} SELECT block_id, {PROV} AS provision FROM b WHERE text IS NOT NULL")
def provision_classify(spark: SparkSession, d: str) -> DataFrame:
    return blocks(spark, d).where("text is not null").select("block_id", do.provision("text").alias("provision"))


@query(f"""WITH {B}, x AS (SELECT *, trim(text) AS t, coalesce(provision, '') AS p FROM b),
 k AS (SELECT *, coalesce(kind = 'text', false) AND NOT ends_with(coalesce(t, ''), ':') AND (list_contains(['-', '–', '—', '*', '•', '·', '▪', '●', '○', '◦'], split_part(t, ' ', 1)) OR (ends_with(split_part(t, ' ', 1), ')') AND list_contains(['a', 'b', 'c', 'd', 'e', 'f', 'g', 'h', 'i', 'ii', 'iii', 'iv', 'v', 'vi'] || list_transform(range(0, 100), lambda i: i::VARCHAR), replace(replace(split_part(t, ' ', 1), '(', ''), ')', ''))) OR (length(split_part(t, ' ', 1)) IN (2, 3) AND ends_with(split_part(t, ' ', 1), '.') AND regexp_full_match(replace(split_part(t, ' ', 1), '.', ''), '[a-z]+'))) AS item FROM x),
 y AS (SELECT *, last_value(CASE WHEN NOT item THEN CASE WHEN kind = 'text' AND p IN ('requirement', 'recommendation', 'permission') AND ends_with(t, ':') THEN p ELSE '' END END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lead_in FROM k)
 SELECT block_id, CASE WHEN item AND p = '' THEN coalesce(lead_in, '') ELSE p END AS inherited FROM y""")
def list_islands(spark: SparkSession, d: str) -> DataFrame:
    """List items take the provision of their lead-in."""
    return do.inherit(blocks(spark, d), "doc_id", ["seq", "block_id"]).select("block_id", "inherited")


XR = f"""WITH {B}, x AS (SELECT doc_id, block_id, coalesce(label, '') AS label, unnest(""" + " || ".join(f"list_transform(regexp_extract_all(text, '{p}', 1), lambda t: {{'kind': '{k}', 'target': t}})" for k, p in do.XREF) + """) AS x FROM b WHERE text IS NOT NULL),
 rf AS (SELECT DISTINCT doc_id, block_id, x.kind AS kind, x.target AS target FROM x WHERE lower(x.kind || ' ' || x.target) <> lower(label)),
 lb AS (SELECT doc_id, lower(label) AS l, arg_min(block_id, struct_pack(seq := seq, id := block_id)) AS b1 FROM b WHERE label <> '' GROUP BY 1, 2),
 cl AS (SELECT doc_id, clause_num, arg_min(block_id, struct_pack(h := (kind <> 'heading')::INT, seq := seq, id := block_id)) AS b2 FROM b WHERE clause_num <> '' GROUP BY 1, 2),
 rs AS (SELECT rf.*, CASE WHEN rf.kind IN ('table', 'figure') THEN b1 WHEN rf.kind = 'clause' THEN b2 END AS to_block FROM rf LEFT JOIN lb ON lb.doc_id = rf.doc_id AND lb.l = rf.kind || ' ' || rf.target LEFT JOIN cl ON cl.doc_id = rf.doc_id AND cl.clause_num = rf.target)"""


@query(XR + " SELECT * FROM rf")
def xref_extract(spark: SparkSession, d: str) -> DataFrame:
    return do.xrefs(blocks(spark, d).where("text is not null"))


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d)
    return do.resolve(do.xrefs(b.where("text is not null")), b)


@query(XR + " SELECT doc_id, block_id, kind, target, coalesce(to_block, -1) AS to_block FROM rs")
def xref_resolve(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d).withColumn("to_block", F.coalesce("to_block", F.lit(-1)))


@query(XR + " SELECT b.doc_id, b.page, count(*) AS n_refs, count(DISTINCT rs.to_block) AS n_targets FROM rs JOIN b USING (block_id) WHERE NOT (rs.kind = 'clause' AND rs.to_block IS NULL) GROUP BY 1, 2")
def page_refs(spark: SparkSession, d: str) -> DataFrame:
    """References of each page; unresolved clauses are dropped."""
    r = _resolved(spark, d).where("not (kind = 'clause' and to_block is null)").drop("doc_id")
    b = blocks(spark, d).select("block_id", "doc_id", "page")
    return r.join(b, "block_id").groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n_refs"), F.count_distinct("to_block").alias("n_targets"))


@query(XR + " SELECT t.doc_id, t.page, s.page AS from_page, count(*) AS n FROM rs JOIN b s ON s.block_id = rs.block_id JOIN b t ON t.block_id = rs.to_block WHERE s.page <> t.page GROUP BY ALL")
def referenced_from(spark: SparkSession, d: str) -> DataFrame:
    """Which other pages refer to what is on a page."""
    b = blocks(spark, d).select("block_id", "doc_id", "page")
    r = _resolved(spark, d).select("block_id", "to_block").where("to_block is not null")
    x = r.join(b.select("block_id", F.col("page").alias("from_page")), "block_id").join(b.select(F.col("block_id").alias("to_block"), "doc_id", "page"), "to_block")
    return x.where("from_page <> page").groupBy("doc_id", "page", "from_page").agg(F.count(F.lit(1)).alias("n"))


CAP = r"(?i)^\s*(table|figure|fig\.)\s+([A-Z]?\d+(?:[-.]\d+)*)\.?\s*(.*)$"


@query(f"WITH {B} SELECT block_id, lower(regexp_extract(text, '{CAP}', 1)) AS kind, regexp_extract(text, '{CAP}', 2) AS number, length(trim(regexp_extract(text, '{CAP}', 3))) AS n_title FROM b WHERE kind = 'table'")
def caption_parse(spark: SparkSession, d: str) -> DataFrame:
    c = do.caption("text")
    x = blocks(spark, d).where("kind = 'table'").select("block_id", *[v.alias(k) for k, v in c.items()])
    return x.select("block_id", "kind", "number", F.length("title").cast("long").alias("n_title"))


@query(f"WITH {B}, x AS (SELECT doc_id, coalesce(nullif(label, ''), block_id::VARCHAR) AS part, block_id, seq FROM b WHERE kind = 'table') SELECT doc_id, part, count(*) AS n_parts, string_agg(block_id::VARCHAR, ',' ORDER BY seq, block_id) AS parts FROM x GROUP BY 1, 2")
def table_parts(spark: SparkSession, d: str) -> DataFrame:
    """Tables of one label are parts of one table; those without stand alone."""
    x = blocks(spark, d).where("kind = 'table'").withColumn("part", F.coalesce(F.nullif("label", F.lit("")), F.col("block_id").cast("string")))
    p = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "block_id"))), lambda r: r["block_id"].cast("string")), ",")
    return x.groupBy("doc_id", "part").agg(F.count(F.lit(1)).alias("n_parts"), p.alias("parts"))


@query(f"WITH {B} SELECT doc_id, clause_path, arg_min(block_id, struct_pack(seq := seq, id := block_id)) AS block_id, arg_min(page, struct_pack(seq := seq, id := block_id)) AS page, arg_min(clause_title, struct_pack(seq := seq, id := block_id)) AS clause_title FROM b WHERE clause_path <> '' GROUP BY 1, 2")
def outline_first(spark: SparkSession, d: str) -> DataFrame:
    return do.outline(blocks(spark, d))


@query(f"""WITH {B} SELECT doc_id, clause_num, clause_title, md5(string_agg(text, chr(10) ORDER BY seq, block_id)) AS text_md5,
 len(regexp_extract_all(string_agg(text, chr(10) ORDER BY seq, block_id), '(?i)\\b(shall)\\b'))::INT AS n_shall, len(regexp_extract_all(string_agg(text, chr(10) ORDER BY seq, block_id), '(?i)\\b(should)\\b'))::INT AS n_should, len(regexp_extract_all(string_agg(text, chr(10) ORDER BY seq, block_id), '(?i)\\b(may)\\b'))::INT AS n_may
 FROM b WHERE clause_num <> '' AND kind <> 'heading' AND text IS NOT NULL GROUP BY 1, 2, 3""")
def clause_concat(spark: SparkSession, d: str) -> DataFrame:
    return do.clause_texts(blocks(spark, d)).withColumn("text_md5", F.md5("text")).drop("text")


# The SQL reads identifiers in its own way: white-space fields, their trimmed cores, and each field's neighbours.
ID = f"""WITH {B}, st AS (SELECT unnest({do.STRUCTURE!r}) AS word),
 tx AS (SELECT block_id, doc_id, kind, translate(text, chr(160) || chr(8239) || chr(8211) || chr(8209) || chr(8722), '  ---') AS t FROM b WHERE text IS NOT NULL),
 fl AS (SELECT block_id, doc_id, kind, unnest(string_split_regex(t, '\\s+')) AS f, generate_subscripts(string_split_regex(t, '\\s+'), 1) AS i FROM tx),
 nb AS (SELECT *, lead(f) OVER (PARTITION BY block_id ORDER BY i) AS g, lead(f, 2) OVER (PARTITION BY block_id ORDER BY i) AS h, lag(f) OVER (PARTITION BY block_id ORDER BY i) AS e FROM fl),
 ic AS (SELECT *, regexp_replace(f, '^[^A-Za-z0-9_.-]+', '') AS l, regexp_replace(g, '[^A-Za-z0-9]+$', '') AS r FROM nb),
 sp AS (SELECT *, regexp_replace(split_part(regexp_replace(f, '^.*[^A-Z0-9/.-]', ''), ' ', 1), '^\\W+', '') AS lab FROM ic),
 pj AS (SELECT block_id, doc_id, i, i + 1 AS til, split_part(lab, '/', 1) AS a, split_part(lab, '/', 2) AS bb, split_part(r, '/', 1) AS m, split_part(r, '/', 2) AS n FROM sp WHERE regexp_full_match(lab, '[A-Z]{{2,6}}/[A-Z]{{2,6}}') AND regexp_full_match(r, '\\d{{1,6}}/\\d{{1,6}}')),
 ps AS (SELECT block_id, doc_id, i, i + 2 AS til, lab AS a, split_part(replace(g, ',', '/'), '/', 2) AS bb, split_part(g, '/', 1) AS m, regexp_replace(h, '[^A-Za-z0-9]+$', '') AS n FROM sp WHERE regexp_full_match(lab, '[A-Z]{{2,6}}') AND regexp_full_match(g, '\\d{{1,6}}/[A-Z]{{2,6}}') AND regexp_full_match(regexp_replace(h, '[^A-Za-z0-9]+$', ''), '\\d{{1,6}}')),
 pr AS (SELECT * FROM (SELECT * FROM pj UNION ALL SELECT * FROM ps) WHERE a NOT IN (SELECT word FROM st) AND bb NOT IN (SELECT word FROM st)),
 tk AS (SELECT DISTINCT block_id, unnest(range(i, til + 1)) AS i FROM pr),
 lb AS (SELECT block_id, doc_id, i, lab || ' ' || r AS value FROM sp WHERE (regexp_full_match(lab, '[A-Z]{{2,6}}') AND regexp_full_match(r, '\\d{{2,6}}') OR regexp_full_match(lab, '[A-Z]{{1,3}}') AND regexp_full_match(r, '\\d{{1,3}}\\.\\d{{1,3}}[A-Z0-9]*')) AND lab NOT IN (SELECT word FROM st)),
 mx AS (SELECT block_id, doc_id, i, unnest(regexp_extract_all(f, '[\\pL\\pN_.-]+')) AS run FROM sp),
 mv AS (SELECT block_id, doc_id, i, rtrim(run, '.') AS value FROM mx WHERE NOT starts_with(run, '.') AND NOT starts_with(run, '-')),
 mm AS (SELECT * FROM mv WHERE regexp_full_match(value, '[A-Za-z0-9]+([._-][A-Za-z0-9]+)*') AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND NOT regexp_full_match(value, '\\d+(\\.\\d+)?[A-Za-z]{{1,3}}') AND NOT regexp_full_match(value, '[A-Z]\\.\\d+(\\.\\d+)*')
   AND regexp_replace(string_split_regex(upper(value), '[._-]')[1], '\\d+$', '') NOT IN (SELECT word FROM st)),
 v AS (SELECT doc_id, block_id, a || '/' || bb || ' ' || m || '/' || n AS value FROM pr UNION ALL SELECT doc_id, block_id, a || ' ' || m FROM pr
   UNION ALL SELECT doc_id, block_id, value FROM lb WHERE NOT EXISTS (SELECT 1 FROM tk WHERE tk.block_id = lb.block_id AND tk.i = lb.i)
   UNION ALL SELECT doc_id, block_id, value FROM mm WHERE NOT EXISTS (SELECT 1 FROM tk WHERE tk.block_id = mm.block_id AND tk.i = mm.i) AND NOT EXISTS (SELECT 1 FROM lb WHERE lb.block_id = mm.block_id AND lb.i = mm.i - 1 AND ends_with(lb.value, ' ' || mm.value))),
 o AS (SELECT v.*, regexp_replace(upper(value), '[\\s_-]+', '', 'g') AS key, regexp_replace(regexp_replace(upper(value), '[\\s_-]+', '', 'g'), '\\d+', '#', 'g') AS family, CASE WHEN kind = 'heading' THEN 'heading' WHEN kind = 'figure' THEN 'caption' WHEN kind = 'table' THEN 'table' ELSE 'text' END AS role FROM v JOIN b USING (block_id))"""


def _occ(spark: SparkSession, d: str) -> DataFrame:
    return do.identifiers(blocks(spark, d))


@query(ID + " SELECT block_id, value, key, family, role, count(*) AS n FROM o GROUP BY ALL")
def ident_occurrences(spark: SparkSession, d: str) -> DataFrame:
    return _occ(spark, d).groupBy("block_id", "value", "key", "family", "role").agg(F.count(F.lit(1)).alias("n"))


@query(ID + """, p AS (SELECT doc_id, family, count(DISTINCT key) AS n_values, count(DISTINCT block_id) AS n_passages FROM o GROUP BY 1, 2), g AS (SELECT doc_id, family, key, count(DISTINCT block_id) AS n FROM o GROUP BY 1, 2, 3),
 e AS (SELECT doc_id, family, string_agg(key, ', ' ORDER BY rk) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, family ORDER BY n DESC, key) AS rk FROM g) WHERE rk <= 4 GROUP BY 1, 2)
, en AS (SELECT doc_id, family FROM p WHERE n_values >= 3 AND n_passages >= 5), ak AS (SELECT DISTINCT doc_id, key FROM o JOIN en USING (doc_id, family)),
 xt AS (SELECT k.doc_id, k.family, count(DISTINCT k.key) AS n_ext FROM o k JOIN ak a ON a.doc_id = k.doc_id AND length(a.key) < length(k.key) AND starts_with(k.key, a.key) AND NOT (regexp_matches(right(a.key, 1), '\\d') AND regexp_matches(k.key[length(a.key) + 1], '\\d')) GROUP BY 1, 2)
 SELECT doc_id, family, n_values, n_passages, examples, (n_values >= 3 AND n_passages >= 5) OR coalesce(n_ext * 2 >= n_values, false) AS enabled FROM p JOIN e USING (doc_id, family) LEFT JOIN xt USING (doc_id, family)""")
def ident_families(spark: SparkSession, d: str) -> DataFrame:
    return do.families(_occ(spark, d))


@query(ID + """, a AS (SELECT key, value, count(*) AS uses, count(DISTINCT block_id) AS passages FROM o GROUP BY 1, 2) SELECT key, arg_min(value, struct_pack(u := -uses, v := value)) AS display, sum(uses)::BIGINT AS uses, sum(passages)::BIGINT AS passages FROM a GROUP BY 1""")
def ident_catalogue(spark: SparkSession, d: str) -> DataFrame:
    return do.catalogue(_occ(spark, d))


@query(ID + """, q AS (SELECT DISTINCT block_id, key FROM o), x AS (SELECT a.key, b.key AS other, count(*) AS n FROM q a JOIN q b ON a.block_id = b.block_id AND a.key <> b.key GROUP BY 1, 2)
 SELECT key, other, n FROM x QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, other) <= 15""")
def ident_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    """Related identifiers of every identifier."""
    o = _occ(spark, d)
    k = o.select("key").distinct()
    return do.related_identifiers(o, k)


@query(ID + ", c AS (SELECT key, count(*) AS n FROM o WHERE contains(key, 'K1') GROUP BY 1) SELECT key, n, CASE WHEN starts_with(key, 'K1') THEN 1 ELSE 2 END AS tier FROM c ORDER BY tier, n DESC, key LIMIT 12")
def ident_suggest(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers that begin with a text first, then those that hold it, each by use."""
    c = _occ(spark, d).where(F.col("key").contains("K1")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("tier", F.when(F.col("key").startswith("K1"), 1).otherwise(2)).orderBy("tier", F.desc("n"), "key").limit(12)


@query(ID + r""", k AS (SELECT DISTINCT key FROM o), pp AS (SELECT a.key, b.key AS parent, length(b.key) AS rank FROM k a JOIN k b ON length(b.key) < length(a.key) AND starts_with(a.key, b.key) AND NOT (regexp_matches(right(b.key, 1), '\d') AND regexp_matches(a.key[length(b.key) + 1], '\d'))
   UNION ALL SELECT a.key, b.key, 0 FROM k a JOIN k b ON regexp_full_match(a.key, '[A-Z]+/[A-Z]+\d+/\d+') AND b.key = split_part(a.key, '/', 1) || regexp_extract(split_part(a.key, '/', 2), '\d+$'))
 SELECT key, arg_max(parent, rank) AS parent FROM pp GROUP BY 1""")
def parent_prefix(spark: SparkSession, d: str) -> DataFrame:
    return do.parent_keys(_occ(spark, d))


@query(ID + """, q AS (SELECT DISTINCT block_id, key FROM o), s AS (SELECT key, count(*) AS spread FROM q GROUP BY 1)
 SELECT a.block_id AS query_id, b.block_id, round(sum(1.0 / ln(1 + spread)), 6) AS weight, count(*) AS n_shared FROM q a JOIN q b USING (key) JOIN s USING (key) WHERE a.block_id % 100 = 0 AND b.block_id <> a.block_id GROUP BY 1, 2""")
def shared_identifiers(spark: SparkSession, d: str) -> DataFrame:
    """Passages sharing identifiers with each passage whose id is divisible by 100, rare ones weighing more; spread is
    counted over the whole library."""
    q = _occ(spark, d).select("block_id", "key").distinct()
    mine = q.where("block_id % 100 = 0").select("key", F.col("block_id").alias("query_id"))
    s = q.join(mine.select("key"), "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("spread"))
    x = q.join(mine.join(s, "key"), "key").where("block_id <> query_id")
    return x.groupBy("query_id", "block_id").agg(F.round(F.sum(1.0 / F.log(1.0 + F.col("spread"))), 6).alias("weight"), F.count(F.lit(1)).alias("n_shared"))


@query(ID + ", r AS (SELECT o.key, CASE WHEN b.kind = 'heading' THEN 'defined' WHEN b.kind = 'table' THEN 'table' WHEN coalesce(b.provision, '') IN ('requirement', 'recommendation') THEN 'rule' ELSE 'mention' END AS grp FROM o JOIN b USING (block_id)) SELECT key, grp, count(*) AS n FROM r GROUP BY 1, 2")
def ident_groups(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d).select("block_id", "kind", F.coalesce("provision", F.lit("")).alias("pv"))
    g = F.when(F.col("kind") == "heading", "defined").when(F.col("kind") == "table", "table").when(F.col("pv").isin("requirement", "recommendation"), "rule").otherwise("mention")
    return _occ(spark, d).join(b, "block_id").groupBy("key", g.alias("grp")).agg(F.count(F.lit(1)).alias("n"))


@query(ID + """, p AS (SELECT doc_id, family, list(DISTINCT key) AS ks FROM o GROUP BY 1, 2), nx AS (SELECT doc_id, lead(doc_id) OVER (ORDER BY doc_id) AS nd FROM (SELECT DISTINCT doc_id FROM p))
 SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, a.family, len(a.ks) AS n_a, len(b.ks) AS n_b, array_to_string(list_sort(list_filter(a.ks, lambda x: NOT list_contains(b.ks, x))), ' ') AS only_a, array_to_string(list_sort(list_filter(b.ks, lambda x: NOT list_contains(a.ks, x))), ' ') AS only_b
 FROM nx JOIN p a ON a.doc_id = nx.doc_id JOIN p b ON b.doc_id = nx.nd AND b.family = a.family""")
def family_differences(spark: SparkSession, d: str) -> DataFrame:
    """Per family that a document and the next one by id both have: how many identifiers each has, and which the other has
    not."""
    p = _occ(spark, d).groupBy("doc_id", "family").agg(F.collect_set("key").alias("keys"))
    n = do.next_ids(p.select("doc_id").distinct(), "doc_id")
    a = p.join(n, "doc_id").select(F.col("doc_id").alias("doc_a"), F.col("next").alias("doc_b"), "family", F.col("keys").alias("ka"))
    x = a.join(p.select(F.col("doc_id").alias("doc_b"), "family", F.col("keys").alias("kb")), ["doc_b", "family"])
    only = lambda u, v: F.array_join(F.array_sort(F.array_except(u, v)), " ")
    return x.select("doc_a", "doc_b", "family", F.size("ka").cast("long").alias("n_a"), F.size("kb").cast("long").alias("n_b"), only("ka", "kb").alias("only_a"), only("kb", "ka").alias("only_b"))




@query()
def quantities(spark: SparkSession, d: str) -> DataFrame:
    return do.quantities(blocks(spark, d).where("text is not null"))


@query(f"""WITH {B}, r AS (SELECT doc_id, clause_num, block_id, CASE provision WHEN 'requirement' THEN 3 WHEN 'recommendation' THEN 2 WHEN 'permission' THEN 1 ELSE 0 END AS s FROM b WHERE clause_num <> '' AND kind = 'text'),
 p AS (SELECT block_id AS a, s AS sa, lead(block_id) OVER w AS b, lead(s) OVER w AS sb FROM r WINDOW w AS (PARTITION BY doc_id, clause_num ORDER BY block_id)) SELECT a, b, CASE WHEN sb > sa THEN 'stronger' ELSE 'weaker' END AS finding FROM p WHERE b IS NOT NULL AND sa > 0 AND sb > 0 AND sa <> sb""")
def assess_obligation(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring passages of a clause whose obligations differ in strength."""
    b = blocks(spark, d)
    w = Window.partitionBy("doc_id", "clause_num").orderBy("block_id")
    pairs = b.where("clause_num <> '' and kind = 'text'").select(F.col("block_id").alias("a"), F.lead("block_id").over(w).alias("b")).where("b is not null")
    st = b.select("block_id", F.when(F.col("provision") == "requirement", 3).when(F.col("provision") == "recommendation", 2).when(F.col("provision") == "permission", 1).otherwise(0).alias("strength"))
    return do.assess(pairs, do.quantities(b.where("text is not null")), st).where("finding <> 'values'")


@query(f"WITH {B}, x AS (SELECT doc_id, page, page_label, count(*) AS n FROM b WHERE page_label <> '' GROUP BY ALL), p AS (SELECT doc_id, count(DISTINCT page) AS pages FROM b GROUP BY 1), s AS (SELECT doc_id, page_label FROM x JOIN p USING (doc_id) GROUP BY 1, 2, pages HAVING count(*) > 1 AND count(*) > 0.2 * pages) SELECT doc_id, page, arg_min(page_label, struct_pack(n := -n, l := page_label)) AS label FROM x WHERE (doc_id, page_label) NOT IN (SELECT doc_id, page_label FROM s) GROUP BY 1, 2")
def page_labels(spark: SparkSession, d: str) -> DataFrame:
    return do.printed_labels(blocks(spark, d))


@query(rf"""WITH {B}, l AS (SELECT doc_id, page, unnest(list_distinct([string_split(text, chr(10))[1], string_split(text, chr(10))[-1]])) AS l FROM b WHERE text IS NOT NULL), k AS (SELECT DISTINCT doc_id, page, regexp_replace(trim(l), '\d+', '#', 'g') AS line FROM l WHERE trim(l) <> ''),
 p AS (SELECT doc_id, count(DISTINCT page) AS pages FROM b GROUP BY 1) SELECT doc_id, line, count(*) AS n FROM k JOIN p USING (doc_id) GROUP BY doc_id, line, pages HAVING count(*) >= 3 AND count(*) >= 0.5 * pages""")
def running_text(spark: SparkSession, d: str) -> DataFrame:
    return do.running_text(blocks(spark, d))


@query(XR + f""", h AS (SELECT doc_id, count(*) AS n_blocks, count(DISTINCT page) AS n_pages, count(*) FILTER (kind = 'heading') AS n_headings, count(*) FILTER (kind = 'table') AS n_tables, count(*) FILTER (kind = 'table' AND coalesce(label, '') = '') AS uncaptioned,
  round(avg((coalesce(clause_num, '') <> '')::INT), 6) AS in_clause, round(avg((coalesce(page_label, '') <> '')::INT), 6) AS labelled, count(*) FILTER (provision = 'requirement') AS n_requirements, coalesce(sum(word_count), 0)::BIGINT AS n_words FROM b GROUP BY 1),
 q AS (SELECT doc_id, count(*) AS n_refs, count(*) FILTER (to_block IS NULL) AS unresolved FROM rs GROUP BY 1) SELECT h.*, coalesce(n_refs, 0) AS n_refs, coalesce(unresolved, 0) AS unresolved FROM h LEFT JOIN q USING (doc_id)""")
def health_report(spark: SparkSession, d: str) -> DataFrame:
    return do.health(blocks(spark, d), _resolved(spark, d))


@query()
def edition_compare(spark: SparkSession, d: str) -> DataFrame:
    """Clauses of consecutive editions: documents of one series, each against the next by title and id."""
    b = blocks(spark, d)
    x = docs(spark, d).where("series is not null and block_count > 0").select("doc_id", "title")
    w = Window.partitionBy("title").orderBy("doc_id")
    pairs = x.select("doc_id", F.lead("doc_id").over(w).alias("next")).where("next is not null")
    c = do.clause_texts(b).groupBy("doc_id", "clause_num").agg(F.min("clause_title").alias("title"), F.min("text").alias("text"))
    old = pairs.select(F.col("doc_id").alias("pair"), "doc_id").join(c, "doc_id").select("pair", F.col("clause_num").alias("num"), "title", "text")
    c2 = c.select(F.col("doc_id").alias("next"), F.col("clause_num").alias("num"), F.concat("title", F.lit("")).alias("title"), F.concat("text", F.lit("")).alias("text"))
    new = pairs.select((F.col("doc_id") + 0).alias("pair"), "next").join(c2, "next").select("pair", "num", "title", "text")
    return do.compare_editions(old, new).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {D} SELECT doc_id, row_number() OVER (PARTITION BY series ORDER BY regexp_replace(upper(filename), '[0-9]', '', 'g'), doc_id) AS pos FROM dd WHERE series IS NOT NULL")
def series_order(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("series").orderBy(F.regexp_replace(F.upper("filename"), "[0-9]", ""), "doc_id")
    return docs(spark, d).where("series is not null").select("doc_id", F.row_number().over(w).cast("long").alias("pos"))


@query(f"""WITH {B}, k AS (SELECT DISTINCT clause_num FROM b WHERE clause_num <> '') SELECT clause_num, array_to_string(list_transform(string_split(clause_num, '.'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]+$') THEN lpad(p, 20, '0') ELSE p END), '.') AS sort_key FROM k""")
def natural_sort(spark: SparkSession, d: str) -> DataFrame:
    k = blocks(spark, d).where("clause_num <> ''").select("clause_num").distinct()
    return k.select("clause_num", tx.natural_key("clause_num").alias("sort_key"))




@query("""WITH c AS (SELECT pin_key, generate_subscripts(table_data.cells, 1) AS r, unnest(table_data.cells) AS cells FROM (SELECT DISTINCT ON (pin_key) * FROM pins) WHERE table_data IS NOT NULL), v AS (SELECT pin_key AS table_id, generate_subscripts(cells, 1) - 1 AS col, trim(unnest(cells)) AS v FROM c),
 s AS (SELECT table_id, col, avg(regexp_matches(v, '^[-+]?\\d+([.,]\\d+)?$')::INT) AS n, avg((regexp_matches(v, '\\d') AND regexp_matches(v, '^[A-Z0-9./x-]+( [A-Z0-9./-]+)?$'))::INT) AS c, avg(regexp_matches(v, '[A-Za-z]+ [A-Za-z]+')::INT) AS w FROM v WHERE length(v) > 0 GROUP BY 1, 2)
 SELECT table_id, col, CASE WHEN n >= 0.8 THEN 'number' WHEN c >= 0.6 THEN 'code' WHEN w >= 0.6 THEN 'words' ELSE 'other' END AS class FROM s""")
def column_classify(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pins").dropDuplicates(["pin_key"]).where("table_data is not null")
    r = p.select(F.col("pin_key").alias("table_id"), F.posexplode("table_data.cells").alias("row", "cs"))
    c = r.select("table_id", "row", F.posexplode("cs").alias("col", "value"))
    return do.classify_columns(c).withColumn("col", F.col("col").cast("long"))


@query("""WITH c AS (SELECT pin_key, generate_subscripts(table_data.cells, 1) AS r, unnest(table_data.cells) AS cells FROM (SELECT DISTINCT ON (pin_key) * FROM pins) WHERE table_data IS NOT NULL), f AS (SELECT pin_key, r, try_cast(cells[-1] AS INT) AS width FROM c), g AS (SELECT * FROM f WHERE width IS NOT NULL)
 SELECT pin_key, r::BIGINT AS field_no, coalesce(sum(width) OVER (PARTITION BY pin_key ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at FROM g""")
def layout_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Offsets of fields from the widths in a table's last column."""
    p = table(spark, d, "pins").dropDuplicates(["pin_key"]).where("table_data is not null")
    r = p.select("pin_key", F.posexplode("table_data.cells").alias("r", "cs")).select("pin_key", (F.col("r") + 1).cast("long").alias("field_no"), F.expr("try_cast(element_at(cs, -1) as int)").alias("width")).where("width is not null")
    return do.layout(r, "pin_key", "field_no", "width").select("pin_key", "field_no", F.col("at").cast("long").alias("at"))


@query(f"WITH {B}, x AS (SELECT doc_id, block_id, seq, clause_title FROM b WHERE kind = 'heading' AND clause_title <> '') SELECT block_id, CASE WHEN n > 1 THEN clause_title || '_' || n ELSE clause_title END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, clause_title ORDER BY seq, block_id) AS n FROM x)")
def unique_titles(spark: SparkSession, d: str) -> DataFrame:
    x = blocks(spark, d).where("kind = 'heading' and clause_title <> ''")
    return do.number_duplicates(x, "doc_id", "clause_title", ["seq", "block_id"]).select("block_id", "unique_name")


@query(f"WITH {D} SELECT doc_id, coalesce(title, '') AS title, coalesce(extract_version, 0) < 3 AS outdated, embedding_model IS NOT NULL AND embedding_model <> '' AS has_meaning, count(*) OVER (PARTITION BY sha256) AS n_same FROM dd")
def document_list(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d)
    n = x.groupBy("sha256").agg(F.count(F.lit(1)).alias("n_same"))
    y = x.join(n, x["sha256"].eqNullSafe(n["sha256"]))
    return y.select("doc_id", F.coalesce("title", F.lit("")).alias("title"), (F.coalesce("extract_version", F.lit(0)) < 3).alias("outdated"), (F.col("embedding_model").isNotNull() & (F.col("embedding_model") != "")).alias("has_meaning"), "n_same")


@query(f"WITH {D} SELECT min(doc_id) AS doc_id, md5(text) AS h, count(*) AS n FROM dd WHERE text IS NOT NULL GROUP BY 2 HAVING count(*) > 1")
def duplicate_documents(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d).where("text is not null").groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    return x.where("n > 1").select("doc_id", "h", "n")


@query("WITH p AS (SELECT DISTINCT ON (pin_key) * FROM pins) SELECT collection_id, count(*) AS n_pins, count(DISTINCT doc_id) AS n_docs, count(*) FILTER (table_data IS NOT NULL) AS n_tables, max(added_at) AS last_added FROM p GROUP BY 1")
def collection_counts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pins").dropDuplicates(["pin_key"])
    return p.groupBy("collection_id").agg(F.count(F.lit(1)).alias("n_pins"), F.count_distinct("doc_id").alias("n_docs"), F.count_if(F.col("table_data").isNotNull()).alias("n_tables"), F.max("added_at").alias("last_added"))


@query("WITH p AS (SELECT DISTINCT ON (pin_key) * FROM pins), f AS (SELECT collection_id, marking, min(added_at) AS t FROM p WHERE marking <> '' GROUP BY 1, 2) SELECT collection_id, string_agg(marking, ' | ' ORDER BY t, marking) AS markings FROM f GROUP BY 1")
def collection_markings(spark: SparkSession, d: str) -> DataFrame:
    """Distinct markings of a collection, the earliest first."""
    f = table(spark, d, "pins").where("marking <> ''").groupBy("collection_id", "marking").agg(F.min("added_at").alias("t"))
    return f.groupBy("collection_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "marking"))), lambda r: r["marking"]), " | ").alias("markings"))


@query("SELECT pin_key, doc_title || CASE WHEN clause <> '' THEN ', ' || clause ELSE '' END || CASE WHEN label <> '' THEN ', ' || label ELSE '' END || CASE WHEN page IS NOT NULL THEN ', p. ' || page ELSE '' END AS citation FROM (SELECT DISTINCT ON (pin_key) * FROM pins) WHERE doc_title IS NOT NULL")
def citation_strings(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pins").dropDuplicates(["pin_key"]).where("doc_title is not null")
    return p.select("pin_key", F.concat_ws(", ", "doc_title", F.nullif("clause", F.lit("")), F.nullif("label", F.lit("")), F.concat(F.lit("p. "), F.col("page").cast("string"))).alias("citation"))


@query("SELECT query, max(added_at) AS last_used, count(*) AS n FROM (SELECT DISTINCT ON (pin_key) * FROM pins) WHERE query <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def recent_searches(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pins").dropDuplicates(["pin_key"]).where("query <> ''")
    return p.groupBy("query").agg(F.max("added_at").alias("last_used"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("last_used"), "query").limit(12)


@query(f"WITH {B}, m AS (SELECT block_id, unnest(list_distinct(regexp_extract_all(text, '\\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\\b', 1))) AS name FROM b), s AS (SELECT DISTINCT regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS k, symbol_id FROM code_symbols) SELECT m.block_id, m.name, count(*) AS n_symbols FROM m JOIN s ON s.k = lower(m.name) GROUP BY 1, 2")
def code_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Names in prose that are symbols, compared without case and separators."""
    m = blocks(spark, d).select("block_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b"), F.lit(1)))).alias("name"))
    s = table(spark, d, "code_symbols").select(F.regexp_replace(F.lower("name"), "[^a-z0-9]", "").alias("k"), "symbol_id").distinct().groupBy("k").agg(F.count(F.lit(1)).alias("c"))
    return m.join(s, F.lower("name") == F.col("k")).select("block_id", "name", F.col("c").alias("n_symbols"))


@query(r"""WITH dd AS (SELECT DISTINCT ON (doc_id) doc_id, text FROM documents), m AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b', 1))) AS name FROM dd), s AS (SELECT lower(regexp_replace(name, '\d+$', '')) AS k, count(DISTINCT symbol_id) AS c FROM code_symbols WHERE kind IN ('class', 'interface', 'enum', 'record') GROUP BY 1) SELECT doc_id, name, c AS n_symbols FROM m JOIN s ON s.k = lower(m.name)""")
def document_type_mentions(spark: SparkSession, d: str) -> DataFrame:
    m = docs(spark, d).select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b"), F.lit(1)))).alias("name"))
    s = table(spark, d, "code_symbols").where("kind in ('class', 'interface', 'enum', 'record')").groupBy(F.lower(F.regexp_replace("name", r"\d+$", "")).alias("k")).agg(F.count_distinct("symbol_id").alias("n_symbols"))
    return m.join(s, F.lower("name") == F.col("k")).select("doc_id", "name", "n_symbols")
