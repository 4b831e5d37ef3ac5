"""Queries over code symbols, references, files and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import codegraph as cg
from ..sources import files as src
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


def syms(spark: SparkSession, d: str) -> DataFrame:
    return cg.symbols(table(spark, d, "code_symbols"))


def refs(spark: SparkSession, d: str) -> DataFrame:
    return cg.references(table(spark, d, "code_refs"))


def files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "code_files").dropDuplicates(["file_id"])


S = "s AS (SELECT DISTINCT ON (symbol_id) * FROM code_symbols)"
R = "r AS (SELECT DISTINCT ON (ref_id) * EXCLUDE (loaded_at) FROM code_refs)"
FI = "f AS (SELECT DISTINCT ON (file_id) * FROM code_files)"
TYPES = "('class', 'interface', 'enum', 'record')"
EXT = f"e AS (SELECT DISTINCT from_symbol AS sub, target_id AS sup FROM r WHERE kind = 'extends' AND target_id >= 1 AND from_symbol >= 1 AND from_symbol <> target_id AND from_symbol IN (SELECT symbol_id FROM s WHERE kind IN {TYPES}) AND target_id IN (SELECT symbol_id FROM s WHERE kind IN {TYPES}))"
CALLS = "c AS (SELECT from_symbol AS caller, target_id AS callee, min(line) AS line FROM r WHERE kind IN ('call', 'new', 'jsx') AND target_id >= 1 AND from_symbol >= 1 AND from_symbol <> target_id GROUP BY 1, 2)"


@query(f"""WITH RECURSIVE {S}, {R}, {EXT}, h AS (SELECT sub, sup, 1 AS depth FROM e UNION SELECT h.sub, e.sup, h.depth + 1 FROM h JOIN e ON e.sub = h.sup WHERE h.depth < 8),
 ov AS (SELECT DISTINCT a.symbol_id, b.symbol_id AS overridden FROM s a JOIN (SELECT DISTINCT sub, sup FROM h WHERE sub <> sup) x ON x.sub = a.parent_id JOIN s b ON b.parent_id = x.sup AND b.name = a.name WHERE a.kind = 'method' AND b.kind = 'method' AND (a.params = b.params OR a.params = -1 OR b.params = -1)),
 u AS (SELECT s.symbol_id, ref_id, CASE WHEN via = 'rule' THEN 'rule' ELSE 'linked' END AS how FROM r JOIN s ON s.symbol_id = r.target_id WHERE target_id >= 1
 UNION SELECT s.symbol_id, ref_id, 'name' FROM r JOIN s ON s.codebase_id = r.codebase_id AND s.name = r.name WHERE r.target_id IS NULL AND r.target IS NULL AND r.kind IN ('call', 'new') AND s.kind IN ('method', 'function') AND (r.args = -1 OR s.params = -1 OR r.args = s.params)
 UNION SELECT ov.symbol_id, ref_id, 'through' FROM r JOIN ov ON ov.overridden = r.target_id)
 SELECT how, count(*) AS n, count(DISTINCT symbol_id) AS n_symbols FROM u GROUP BY 1""")
def usages_tagged(spark: SparkSession, d: str) -> DataFrame:
    r, s = refs(spark, d), syms(spark, d)
    supers = cg.closure(cg.extends_edges(r, s), "sub", "sup", max_depth=8)
    return cg.usages(r, s, supers).groupBy("how").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("symbol_id").alias("n_symbols"))


@query(f"WITH {S}, {R} SELECT s.symbol_id, count(*) AS n_uses, min(r.line) AS first_line FROM r JOIN s ON s.symbol_id = r.target_id GROUP BY 1")
def linked_counts(spark: SparkSession, d: str) -> DataFrame:
    r = refs(spark, d).where("target_id >= 1").groupBy("target_id").agg(F.count(F.lit(1)).alias("n_uses"), F.min("line").alias("first_line"))
    return r.join(syms(spark, d).select("symbol_id"), F.col("target_id") == F.col("symbol_id")).select("symbol_id", "n_uses", "first_line")


PK = "p AS (SELECT file_id, package FROM f WHERE package IS NOT NULL AND package <> '')"
DEPS = f"""WITH {S}, {R}, {FI}, {PK}, k AS (SELECT r.codebase_id, a.package AS src, b.package AS dst, count(*) AS n FROM r JOIN s ON s.symbol_id = r.target_id JOIN p a ON a.file_id = r.file_id JOIN p b ON b.file_id = s.file_id WHERE a.package <> b.package GROUP BY ALL)"""


def _deps(spark: SparkSession, d: str) -> DataFrame:
    """References between packages of a codebase, counted per file and target before the packages are joined."""
    n = refs(spark, d).where("target_id >= 1").groupBy("codebase_id", "file_id", "target_id").agg(F.count(F.lit(1)).alias("n"))
    p = files(spark, d).where("package is not null and package <> ''").select("file_id", "package")
    s = syms(spark, d).select(F.col("symbol_id"), F.col("file_id").alias("t_file"))
    x = n.join(s, F.col("target_id") == F.col("symbol_id")).join(p.select("file_id", F.col("package").alias("src")), "file_id").join(p.select(F.col("file_id").alias("t_file"), F.col("package").alias("dst")), "t_file")
    return x.where("src <> dst").groupBy("codebase_id", "src", "dst").agg(F.sum("n").alias("n"))


@query(DEPS + " SELECT codebase_id, src, dst, n FROM k")
def package_deps(spark: SparkSession, d: str) -> DataFrame:
    return _deps(spark, d)


@query(DEPS + """, q AS (SELECT DISTINCT src, dst FROM k), o AS (SELECT src AS package, count(*) AS n_out FROM q GROUP BY 1), i AS (SELECT dst AS package, count(*) AS n_in FROM q GROUP BY 1)
 SELECT coalesce(o.package, i.package) AS package, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) - coalesce(n_in, 0) AS rank_key FROM o FULL JOIN i ON o.package = i.package""")
def layering(spark: SparkSession, d: str) -> DataFrame:
    return cg.layers(_deps(spark, d))


EXTP = "CASE WHEN contains(target, '.') THEN regexp_replace(split_part(target, '#', 1), '\\.[^.]*$', '') ELSE split_part(target, '#', 1) END"


@query(f"WITH {R}, u AS (SELECT {EXTP} AS package, file_id FROM r WHERE target IS NOT NULL AND target <> '') SELECT package, count(*) AS n_uses, count(DISTINCT file_id) AS n_files FROM u GROUP BY 1")
def external_packages(spark: SparkSession, d: str) -> DataFrame:
    owner = F.substring_index("target", "#", 1)
    pkg = F.when(F.col("target").contains("."), F.regexp_replace(owner, r"\.[^.]*$", "")).otherwise(owner)
    x = refs(spark, d).where("target is not null and target <> ''").select(pkg.alias("package"), "file_id")
    return x.groupBy("package").agg(F.count(F.lit(1)).alias("n_uses"), F.count_distinct("file_id").alias("n_files"))


@query(f"WITH {R} SELECT target, kind, count(*) AS n, min(line) AS first_line FROM r WHERE target LIKE 'java.util.%' GROUP BY 1, 2")
def external_members(spark: SparkSession, d: str) -> DataFrame:
    """Members used of one outside package: a key range, pushed down to the scan."""
    return refs(spark, d).where(F.col("target").startswith("java.util.")).groupBy("target", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first_line"))


@query(f"""WITH RECURSIVE {S}, {R}, {EXT}, h AS (SELECT sub, sup, 1 AS depth FROM e UNION SELECT h.sub, e.sup, h.depth + 1 FROM h JOIN e ON e.sub = h.sup WHERE h.depth < 8)
 SELECT sub, sup, min(depth) AS depth FROM h WHERE sub <> sup GROUP BY 1, 2""")
def hierarchy_closure(spark: SparkSession, d: str) -> DataFrame:
    return cg.closure(cg.extends_edges(refs(spark, d), syms(spark, d)), "sub", "sup", max_depth=8)


@query(f"""WITH RECURSIVE {S}, {R}, {EXT}, h AS (SELECT sub, sup, 1 AS depth FROM e UNION SELECT h.sub, e.sup, h.depth + 1 FROM h JOIN e ON e.sub = h.sup WHERE h.depth < 8)
 SELECT DISTINCT a.symbol_id, b.symbol_id AS overridden FROM s a JOIN (SELECT DISTINCT sub, sup FROM h WHERE sub <> sup) x ON x.sub = a.parent_id JOIN s b ON b.parent_id = x.sup AND b.name = a.name WHERE a.kind = 'method' AND b.kind = 'method' AND (a.params = b.params OR a.params = -1 OR b.params = -1)""")
def override_pairs(spark: SparkSession, d: str) -> DataFrame:
    s = syms(spark, d)
    return cg.overrides(s, cg.closure(cg.extends_edges(refs(spark, d), s), "sub", "sup", max_depth=8))


ROOTS = "root AS (SELECT callee AS symbol_id FROM c GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5)"


def _roots(edges: DataFrame, by: str) -> DataFrame:
    return edges.groupBy(F.col(by).alias("symbol_id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "symbol_id").limit(5).select("symbol_id")


@query(f"""WITH RECURSIVE {R}, {CALLS}, root AS (SELECT caller AS symbol_id FROM c GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5),
 k AS (SELECT *, row_number() OVER (PARTITION BY caller ORDER BY line, callee) AS rk FROM c),
 t AS (SELECT symbol_id AS root, symbol_id AS parent, symbol_id AS node, 0 AS depth, false AS looped, [symbol_id] AS path FROM root
  UNION ALL SELECT t.root, t.node, k.callee, t.depth + 1, list_contains(t.path, k.callee), list_append(t.path, k.callee) FROM t JOIN k ON k.caller = t.node AND k.rk <= 30 WHERE NOT t.looped AND t.depth < 4)
 SELECT root, parent, node, depth, looped, count(*) AS n FROM t WHERE depth > 0 GROUP BY ALL""")
def call_tree(spark: SparkSession, d: str) -> DataFrame:
    e = cg.call_edges(refs(spark, d))
    return cg.call_tree(e, _roots(e, "caller")).groupBy("root", "parent", "node", "depth", "looped").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH RECURSIVE {R}, {CALLS}, {ROOTS}, b AS (SELECT symbol_id AS root, symbol_id AS node, 0 AS depth FROM root UNION SELECT b.root, c.caller, b.depth + 1 FROM b JOIN c ON c.callee = b.node WHERE b.depth < 8),
 m AS (SELECT root, node, min(depth) AS depth FROM b GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY depth, node) AS rk, count(*) OVER (PARTITION BY root) AS n FROM m WHERE depth > 0)
 SELECT root, node, depth, n > 400 AS truncated FROM k WHERE rk <= 400""")
def impact_bfs(spark: SparkSession, d: str) -> DataFrame:
    e = cg.call_edges(refs(spark, d))
    return cg.impact(e, _roots(e, "callee"))


@query(f"""WITH {S}, {R} SELECT s.symbol_id, (SELECT count(*) FROM r WHERE r.target_id IS NULL AND r.target IS NULL AND r.codebase_id = s.codebase_id AND r.name = s.name) AS by_name FROM s
 WHERE s.kind IN ('method', 'function') AND NOT regexp_matches(s.name, '^(main|run|setUp|tearDown|test[A-Z].*|on[A-Z].*|handle[A-Z].*|use[A-Z].*|ng[A-Z].*|init|constructor)$')
 AND s.symbol_id NOT IN (SELECT target_id FROM r WHERE target_id >= 1 AND (from_symbol IS NULL OR from_symbol <> target_id)) AND (s.codebase_id, s.name) NOT IN (SELECT codebase_id, name FROM r WHERE kind = 'import' AND name IS NOT NULL)""")
def unused_symbols(spark: SparkSession, d: str) -> DataFrame:
    return cg.unused(syms(spark, d), refs(spark, d))


SITES = """ca AS (SELECT r.from_symbol AS method, t.parent_id AS type, t.name, r.line, r.col FROM r JOIN s t ON t.symbol_id = r.target_id LEFT JOIN s o ON o.symbol_id = r.from_symbol
 WHERE r.kind = 'call' AND r.from_symbol >= 1 AND r.target_id >= 1 AND t.kind IN ('method', 'function') AND (t.parent_id IS NULL OR o.parent_id IS NULL OR o.parent_id <> t.parent_id))"""


@query(f"""WITH {S}, {R}, {SITES}, ty AS (SELECT type FROM ca WHERE type IS NOT NULL GROUP BY 1 HAVING count(*) >= 3)
 SELECT a.type, a.name AS first, b.name AS second, count(DISTINCT a.method) AS n FROM ca a JOIN ca b ON a.method = b.method AND a.type = b.type AND a.name <> b.name AND (a.line < b.line OR (a.line = b.line AND a.col < b.col)) WHERE a.type IN (SELECT type FROM ty) GROUP BY 1, 2, 3""")
def ordered_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Idioms: which member of a type is called before which other, in how many methods."""
    return cg.ordered_pairs(cg.call_sites(refs(spark, d), syms(spark, d)))


def _rules(support: int, confidence: float) -> str:
    return f"""x AS (SELECT DISTINCT r.from_symbol AS g, t.name AS i FROM r JOIN s t ON t.symbol_id = r.target_id WHERE r.kind = 'call' AND r.from_symbol >= 1 AND t.kind IN ('method', 'function') AND t.name IS NOT NULL), n AS (SELECT i, count(*) AS n FROM x GROUP BY 1),
 p AS (SELECT a.i AS a, b.i AS b, count(*) AS support FROM x a JOIN x b ON a.g = b.g AND a.i < b.i GROUP BY 1, 2 HAVING count(*) >= {support}),
 ru AS (SELECT CASE WHEN na.n <= nb.n THEN a ELSE b END AS antecedent, CASE WHEN na.n <= nb.n THEN b ELSE a END AS consequent, support, round(support / least(na.n, nb.n), 2) AS confidence
 FROM p JOIN n na ON na.i = a JOIN n nb ON nb.i = b WHERE support / least(na.n, nb.n) >= {confidence})"""


def _called(spark: SparkSession, d: str) -> DataFrame:
    """(method, name): member names that a method calls."""
    t = syms(spark, d).where("kind in ('method', 'function') and name is not null").select(F.col("symbol_id").alias("target_id"), F.col("name").alias("item"))
    return refs(spark, d).where("kind = 'call' and from_symbol >= 1").select("target_id", F.col("from_symbol").alias("method")).join(t, "target_id").select("method", "item").distinct()


@query(f"WITH {S}, {R}, {_rules(3, 0.8)} SELECT antecedent, consequent, support, confidence FROM ru")
def assoc_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Members that are called together: in three methods at least, and in 80 % of those that call the rarer one."""
    return cg.association_rules(_called(spark, d), "method", "item")


@query(f"WITH {S}, {R}, {_rules(1, 0.5)} SELECT antecedent, consequent, support, confidence FROM ru")
def assoc_pairs_loose(spark: SparkSession, d: str) -> DataFrame:
    """The same with one method and 50 %: the test data has no pair in three methods."""
    return cg.association_rules(_called(spark, d), "method", "item", 1, 0.5)


@query(f"WITH {S}, {R} SELECT r.target_id AS symbol_id, count(*) AS n_refs FROM r JOIN s ON s.symbol_id = r.target_id WHERE s.kind NOT IN {TYPES} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def hotspots(spark: SparkSession, d: str) -> DataFrame:
    n = refs(spark, d).where("target_id >= 1").groupBy(F.col("target_id").alias("symbol_id")).agg(F.count(F.lit(1)).alias("n_refs"))
    s = syms(spark, d).where(~F.col("kind").isin(*cg.TYPE_KINDS)).select("symbol_id")
    return n.join(s, "symbol_id").orderBy(F.desc("n_refs"), "symbol_id").limit(20)


@query(f"WITH {S}, {R} SELECT s.file_id, count(*) AS n_refs FROM r JOIN s ON s.symbol_id = r.target_id WHERE s.file_id <> r.file_id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def hotspot_files(spark: SparkSession, d: str) -> DataFrame:
    n = refs(spark, d).where("target_id >= 1").groupBy("target_id", "file_id").agg(F.count(F.lit(1)).alias("n"))
    s = syms(spark, d).select("symbol_id", F.col("file_id").alias("t_file"))
    x = n.join(s, F.col("target_id") == F.col("symbol_id")).where("t_file <> file_id").groupBy(F.col("t_file").alias("file_id")).agg(F.sum("n").alias("n_refs"))
    return x.orderBy(F.desc("n_refs"), "file_id").limit(20)


TESTS = r"(regexp_matches(lower(path), '(^|/)(tests?|__tests__|spec|specs|testing)(/|$)') OR regexp_matches(path, '(?i)[._-](test|spec)\\.\\w+$') OR regexp_matches(path, '(Test|Tests|IT|Spec)\\.\\w+$'))"


@query(rf"""WITH {S}, {FI}, t AS (SELECT coalesce(f.package, '') AS package, s.name FROM s JOIN f ON f.file_id = s.file_id WHERE s.kind IN {TYPES} AND s.parent_id IS NULL AND s.name IS NOT NULL AND NOT coalesce({TESTS}, false)),
 w AS (SELECT package, regexp_extract_all(name, '[A-Z][a-z0-9]+|[A-Z]+$|[A-Z]') AS ps FROM t), x AS (SELECT package, array_to_string(ps[i:], '') AS suffix FROM w, range(1, len(ps) + 1) q(i)), n AS (SELECT package, suffix, count(*) AS n FROM x GROUP BY 1, 2),
 c AS (SELECT package, count(*) AS total FROM t GROUP BY 1 HAVING count(*) >= 2)
 SELECT package, suffix, n, total FROM n JOIN c USING (package) WHERE n >= 0.6 * total QUALIFY row_number() OVER (PARTITION BY package ORDER BY n DESC, length(suffix) DESC, suffix) = 1""")
def naming_suffix(spark: SparkSession, d: str) -> DataFrame:
    """The suffix that 60 % of a package's outer types share; test files do not count."""
    f = files(spark, d).where(~cg.is_test("path")).select("file_id", F.coalesce("package", F.lit("")).alias("package"))
    t = syms(spark, d).where(F.col("kind").isin(*cg.TYPE_KINDS) & F.col("parent_id").isNull() & F.col("name").isNotNull()).select("file_id", "name")
    return cg.suffixes(t.join(f, "file_id"), "package", "name")


@query(f"""WITH {FI}, x AS (SELECT list_slice(string_split(path, '/'), 1, -2) AS ps, coalesce({TESTS}, false)::INT AS fl FROM f), u AS (SELECT array_to_string(ps[1:i], '/') AS folder, fl FROM x, range(1, len(ps) + 1) t(i)),
 c AS (SELECT folder, count(*) AS n, sum(fl) AS flagged FROM u GROUP BY 1 HAVING sum(fl) >= 0.8 * count(*)) SELECT folder, n, flagged::BIGINT AS flagged FROM c WHERE NOT EXISTS (SELECT 1 FROM c p WHERE starts_with(c.folder, p.folder || '/'))""")
def folder_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Topmost folders that hold tests: 80 % of their files at least."""
    return cg.folders(files(spark, d).select("path", cg.is_test("path").alias("flag")), "flag")


@query(f"WITH {S}, {R} SELECT s.symbol_id, count(*) FILTER (r.kind = 'new') AS constructed, count(*) FILTER (r.kind = 'type') AS injected, count(*) FILTER (r.kind = 'call') AS factory FROM r JOIN s ON s.symbol_id = r.target_id WHERE s.kind IN {TYPES} GROUP BY 1")
def how_made(spark: SparkSession, d: str) -> DataFrame:
    n = refs(spark, d).where("target_id >= 1").groupBy("target_id").agg(*[F.count_if(F.col("kind") == k).alias(a) for k, a in (("new", "constructed"), ("type", "injected"), ("call", "factory"))])
    return n.join(syms(spark, d).where(F.col("kind").isin(*cg.TYPE_KINDS)).select("symbol_id"), F.col("target_id") == F.col("symbol_id")).select("symbol_id", "constructed", "injected", "factory")


@query(f"WITH {R}, {FI} SELECT coalesce(f.language, '') AS language, count(*) AS n_calls, count(*) FILTER (r.target_id IS NULL AND r.target IS NULL) AS by_name, round(count(*) FILTER (r.target_id IS NULL AND r.target IS NULL) / count(*), 6) AS share FROM r JOIN f USING (file_id) WHERE r.kind = 'call' GROUP BY 1")
def by_name_share(spark: SparkSession, d: str) -> DataFrame:
    n = refs(spark, d).where("kind = 'call'").groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("target_id").isNull() & F.col("target").isNull()).alias("b"))
    x = n.join(files(spark, d).select("file_id", F.coalesce("language", F.lit("")).alias("language")), "file_id").groupBy("language").agg(F.sum("n").alias("n_calls"), F.sum("b").alias("by_name"))
    return x.withColumn("share", F.round(F.col("by_name") / F.col("n_calls"), 6))


@query(f"""WITH {S} SELECT symbol_id, row_number() OVER (ORDER BY lower(name) = 'policyview' DESC, starts_with(lower(name), 'policyview') DESC, contains(lower(name), 'policyview') DESC, length(name), qualified, symbol_id) AS pos FROM s
 WHERE name ILIKE '%policyview%' OR qualified ILIKE '%policyview%' QUALIFY pos <= 300""")
def symbol_search(spark: SparkSession, d: str) -> DataFrame:
    """Exact names first, then prefixes, containing names, shorter names."""
    n = F.lower("name")
    t = "policyview"
    keys = [F.desc(n == t), F.desc(n.startswith(t)), F.desc(n.contains(t)), F.length("name"), "qualified", "symbol_id"]
    x = syms(spark, d).where(F.col("name").ilike(f"%{t}%") | F.col("qualified").ilike(f"%{t}%")).orderBy(*keys).limit(300)
    return x.select("symbol_id", F.row_number().over(Window.orderBy(*keys)).cast("long").alias("pos"))


@query(f"WITH {S}, {R} SELECT ref_id, max(struct_pack(line := s.line, id := s.symbol_id)).id AS symbol_id FROM r JOIN s ON s.file_id = r.file_id AND r.line BETWEEN s.line AND s.end_line GROUP BY 1")
def enclosing_symbol(spark: SparkSession, d: str) -> DataFrame:
    """The innermost symbol whose lines hold a reference: an interval join within a file, over one row per line."""
    s = syms(spark, d).select("file_id", F.col("line").alias("a"), F.col("end_line").alias("b"), "symbol_id")
    r = refs(spark, d).select("ref_id", "file_id", "line")
    lines = r.select("file_id", "line").distinct().join(s, "file_id").where("line between a and b").groupBy("file_id", "line").agg(F.max(F.struct("a", "symbol_id")).alias("m"))
    return r.join(lines, ["file_id", "line"]).select("ref_id", F.col("m.symbol_id").alias("symbol_id"))


@query(f"WITH {R} SELECT file_id, kind, count(*) AS n FROM r WHERE line BETWEEN 10 AND 20 GROUP BY 1, 2")
def refs_on_lines(spark: SparkSession, d: str) -> DataFrame:
    return refs(spark, d).where("line between 10 and 20").groupBy("file_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {S} SELECT symbol_id FROM s WHERE kind IN ('method', 'function') AND params = 1 AND regexp_replace(coalesce(type, ''), '<.*$', '') = 'List' AND name ILIKE '%all%'")
def signature_search(spark: SparkSession, d: str) -> DataFrame:
    base = F.regexp_replace(F.coalesce("type", F.lit("")), r"<.*$", "")
    return syms(spark, d).where("kind in ('method', 'function') and params = 1").where((base == "List") & F.col("name").ilike("%all%")).select("symbol_id")


@query(f"WITH {S} SELECT symbol_id, name FROM s WHERE kind = 'function' AND regexp_matches(name, '^use[A-Z]')")
def hook_functions(spark: SparkSession, d: str) -> DataFrame:
    return syms(spark, d).where("kind = 'function'").where(F.col("name").rlike("^use[A-Z]")).select("symbol_id", "name")


@query(f"""WITH RECURSIVE {S}, u AS (SELECT symbol_id AS id, parent_id AS at, 1 AS k FROM s WHERE parent_id IS NOT NULL UNION ALL SELECT u.id, s.parent_id, u.k + 1 FROM u JOIN s ON s.symbol_id = u.at WHERE u.k < 60 AND s.kind NOT IN {TYPES} AND s.parent_id IS NOT NULL)
 SELECT u.id AS symbol_id, arg_min(s.symbol_id, u.k) AS owner_id FROM u JOIN s ON s.symbol_id = u.at WHERE s.kind IN {TYPES} AND u.id NOT IN (SELECT symbol_id FROM s WHERE symbol_id = parent_id) GROUP BY 1 HAVING min(u.k) < 60""")
def enclosing_type(spark: SparkSession, d: str) -> DataFrame:
    """The nearest type up the chain of parents, by hops that double; a chain without a type, or a loop, has none."""
    s = syms(spark, d).select("symbol_id", "parent_id", F.col("kind").isin(*cg.TYPE_KINDS).alias("is_type"))
    from ..session import Stages

    st = Stages(spark, "owner")
    base = s.select(F.col("symbol_id").alias("t"), "is_type", F.col("parent_id").alias("up"))
    x = st.put(s.where("parent_id is not null and parent_id <> symbol_id").select("symbol_id", F.col("parent_id").alias("at")))
    j = base.select("t", F.when(F.col("is_type"), F.col("t")).alias("owner"), F.when(~F.col("is_type"), F.col("up")).alias("next"))
    hop = st.put(j)
    while True:  # hop: from a symbol to the nearest type at or above it within 2^k steps, or to where the search goes on
        n = hop.select(F.col("t").alias("n_t"), F.col("owner").alias("n_owner"), F.col("next").alias("n_next"))
        nxt = st.put(hop.join(n, F.col("next") == F.col("n_t"), "left").select("t", F.coalesce("owner", "n_owner").alias("owner"), F.when(F.col("owner").isNull() & F.col("n_owner").isNull(), F.col("n_next")).alias("next")))
        before, after = hop.where("next is not null").count(), nxt.where("next is not null").count()
        hop = nxt
        if after in (0, before):
            break
    return x.join(hop.where("owner is not null"), F.col("at") == F.col("t")).select("symbol_id", F.col("owner").alias("owner_id"))


@query("""WITH p AS (SELECT snapshot_id, count(*) AS n_symbols, coalesce(sum(callers), 0)::BIGINT AS n_callers, count(*) FILTER (exported) AS n_exported FROM (SELECT DISTINCT * FROM code_snapshot_symbols) GROUP BY 1)
 SELECT s.snapshot_id, coalesce(n_symbols, 0) AS n_symbols, coalesce(n_callers, 0) AS n_callers, coalesce(n_exported, 0) AS n_exported FROM (SELECT DISTINCT snapshot_id FROM code_snapshots) s LEFT JOIN p ON p.snapshot_id = s.snapshot_id""")
def snapshot_counts(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "code_snapshot_symbols").distinct().groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n_symbols"), F.coalesce(F.sum("callers"), F.lit(0)).alias("n_callers"), F.count_if("exported").alias("n_exported"))
    s = table(spark, d, "code_snapshots").select("snapshot_id").distinct().join(x, "snapshot_id", "left")
    return s.select("snapshot_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_symbols", "n_callers", "n_exported")])


ROUTE_RE = r"(?:fetch|get|post|put|delete)\(`([^`]+)`"


@query(r"""WITH f AS (SELECT DISTINCT ON (file_id) * FROM code_files), u AS (SELECT file_id, unnest(regexp_extract_all(content, '(?:fetch|get|post|put|delete)\(`([^`]+)`', 1)) AS raw FROM f),
 n AS (SELECT file_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '^[a-z]+://[^/]*', ''), '[?#].*$', ''), '\$\{[^}]*\}|\{[^}]*\}|:[A-Za-z_]\w*|<[^>/]+>', '{}', 'g'), '/+$', ''), '^(/?\{\})+', '') AS path FROM u)
 SELECT path, count(*) AS n_calls, count(DISTINCT file_id) AS n_files FROM n GROUP BY 1""")
def client_paths(spark: SparkSession, d: str) -> DataFrame:
    """URL paths that scripts call, with their variables as {}."""
    u = files(spark, d).select("file_id", F.explode(F.regexp_extract_all("content", F.lit(ROUTE_RE), F.lit(1))).alias("raw"))
    return u.groupBy(cg.normal_path("raw").alias("path")).agg(F.count(F.lit(1)).alias("n_calls"), F.count_distinct("file_id").alias("n_files"))


@query(f"WITH {FI}, {R} SELECT r.file_id, count(*) AS n_imports, count(DISTINCT coalesce(r.target, r.target_id::VARCHAR, r.name)) AS n_targets FROM r JOIN f USING (file_id) WHERE r.kind = 'import' GROUP BY 1")
def file_imports(spark: SparkSession, d: str) -> DataFrame:
    r = refs(spark, d).where("kind = 'import'").join(files(spark, d).select("file_id"), "file_id", "left_semi")
    return r.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_imports"), F.count_distinct(F.coalesce("target", F.col("target_id").cast("string"), "name")).alias("n_targets"))


@query(r"""WITH f AS (SELECT DISTINCT ON (file_id) * FROM code_files), i AS (SELECT file_id, codebase_id, path, unnest(regexp_extract_all(content, '(?:from|require\()\s*["'']((?:\./|\.\./)[^"'']+)["'']', 1)) AS spec FROM f),
 d AS (SELECT DISTINCT file_id, codebase_id, spec, list_filter(string_split(regexp_replace(path, '[^/]*$', ''), '/'), lambda x: x <> '' AND x <> '.') AS dir, list_filter(string_split(spec, '/'), lambda x: x <> '' AND x <> '.') AS ps FROM i),
 u AS (SELECT *, len(list_filter(ps, lambda x: x = '..')) AS ups FROM d),
 t AS (SELECT *, array_to_string(list_concat(dir[1:len(dir) - ups], list_filter(ps, lambda x: x <> '..')), '/') AS base FROM u WHERE ups <= len(dir)),
 e AS (SELECT unnest(['', '.ts', '.tsx', '.mts', '.js', '.jsx', '.mjs', '.cjs', '/index.ts', '/index.tsx', '/index.js', '/index.jsx']) AS ext, unnest(range(0, 12)) AS rank),
 k AS (SELECT t.*, rank, base || ext AS p FROM t, e UNION ALL SELECT t.*, 12 + r, regexp_replace(base, '\.[cm]?jsx?$', '') || x FROM t, (VALUES (0, '.ts'), (1, '.tsx'), (2, '.mts')) v(r, x) WHERE regexp_matches(base, '\.[cm]?jsx?$')),
 fm AS (SELECT codebase_id, path, min(file_id) AS target FROM f GROUP BY 1, 2), h AS (SELECT k.file_id, k.spec, arg_min(fm.target, rank) AS target_file FROM k JOIN fm ON fm.codebase_id = k.codebase_id AND fm.path = k.p GROUP BY 1, 2)
 SELECT DISTINCT d.file_id, d.spec, h.target_file FROM d LEFT JOIN h ON h.file_id = d.file_id AND h.spec = d.spec""")
def relative_imports(spark: SparkSession, d: str) -> DataFrame:
    """Relative module names resolved against the importing file's folder and the codebase's files."""
    f = files(spark, d)
    i = f.select("file_id", "codebase_id", "path", F.explode(F.regexp_extract_all("content", F.lit(r"""(?:from|require\()\s*["']((?:\./|\.\./)[^"']+)["']"""), F.lit(1))).alias("spec")).distinct()
    return cg.resolve_relative(i, f)


@query(r"""WITH f AS (SELECT DISTINCT ON (file_id) * FROM code_files), e AS (SELECT file_id, unnest(regexp_extract_all(content, 'throw new (\w+)', 1)) AS error FROM f) SELECT error, count(*) AS n, count(DISTINCT file_id) AS n_files FROM e GROUP BY 1""")
def errors_raised(spark: SparkSession, d: str) -> DataFrame:
    e = files(spark, d).select("file_id", F.explode(F.regexp_extract_all("content", F.lit(r"throw new (\w+)"), F.lit(1))).alias("error"))
    return e.groupBy("error").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file_id").alias("n_files"))


@query(f"WITH {S} SELECT a.symbol_id AS class_id, string_agg(m.name, ',' ORDER BY m.name) AS members FROM s a JOIN (SELECT DISTINCT parent_id, name FROM s WHERE kind = 'method') m ON m.parent_id = a.symbol_id WHERE a.kind = 'class' GROUP BY 1")
def class_members(spark: SparkSession, d: str) -> DataFrame:
    s = syms(spark, d)
    m = s.where("kind = 'method'").select("parent_id", "name").distinct()
    return m.join(s.where("kind = 'class'").select("symbol_id"), F.col("parent_id") == F.col("symbol_id")).groupBy(F.col("symbol_id").alias("class_id")).agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("members"))


@query(f"WITH {S}, {R}, {_rules(1, 0.5)} SELECT x.g AS symbol_id, antecedent, consequent FROM x JOIN ru ON ru.antecedent = x.i WHERE NOT EXISTS (SELECT 1 FROM x y WHERE y.g = x.g AND y.i = ru.consequent)")
def companion_missing(spark: SparkSession, d: str) -> DataFrame:
    """Methods that call a member without the one that elsewhere goes with it (in half of the methods that call it)."""
    c = _called(spark, d)
    return cg.missing_companions(c, "method", "item", cg.association_rules(c, "method", "item", 1, 0.5)).withColumnRenamed("method", "symbol_id")


@query(f"""WITH {FI}, k AS (SELECT file_id, codebase_id, path, sha256 FROM f), n AS (SELECT codebase_id, path, CASE WHEN file_id % 7 = 0 THEN 'new' || sha256 ELSE sha256 END AS sha256 FROM f WHERE file_id % 11 <> 0)
 SELECT CASE WHEN k.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'removed' WHEN k.sha256 IS DISTINCT FROM n.sha256 THEN 'changed' ELSE 'same' END AS state, count(*) AS n FROM (SELECT DISTINCT codebase_id, path, sha256 FROM k) k FULL JOIN (SELECT DISTINCT codebase_id, path, sha256 FROM n) n ON k.codebase_id = n.codebase_id AND k.path = n.path GROUP BY 1""")
def changed_files(spark: SparkSession, d: str) -> DataFrame:
    """A listing against what is known, by path and hash; the new listing is the old one with every 7th file changed and
    every 11th gone."""
    f = files(spark, d)
    known = f.select("codebase_id", "path", "sha256").distinct()
    now = f.where("file_id % 11 <> 0").select(F.col("codebase_id").alias("c2"), F.col("path").alias("p2"), F.when(F.col("file_id") % 7 == 0, F.concat(F.lit("new"), "sha256")).otherwise(F.col("sha256")).alias("h2")).distinct()
    x = known.join(now, (F.col("codebase_id") == F.col("c2")) & (F.col("path") == F.col("p2")), "full")
    state = F.when(F.col("path").isNull(), "new").when(F.col("p2").isNull(), "removed").when(~F.col("sha256").eqNullSafe(F.col("h2")), "changed").otherwise("same")
    return x.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {S}, {R}, ch AS (SELECT file_id FROM code_files WHERE file_id % 50 = 0), sy AS (SELECT symbol_id, name, codebase_id FROM s WHERE file_id IN (SELECT file_id FROM ch))
 SELECT ref_id FROM r WHERE file_id IN (SELECT file_id FROM ch) UNION SELECT ref_id FROM r WHERE target_id IN (SELECT symbol_id FROM sy) UNION SELECT ref_id FROM r WHERE target_id IS NULL AND target IS NULL AND (codebase_id, name) IN (SELECT codebase_id, name FROM sy)""")
def affected_refs(spark: SparkSession, d: str) -> DataFrame:
    """References that a re-link must look at after some files (ids divisible by 50) are saved again."""
    ch = files(spark, d).where("file_id % 50 = 0").select("file_id")
    sy = syms(spark, d).join(ch, "file_id", "left_semi")
    r = refs(spark, d)
    a = r.join(ch, "file_id", "left_semi").select("ref_id")
    b = r.join(sy.select(F.col("symbol_id").alias("target_id")), "target_id", "left_semi").select("ref_id")
    c = r.where("target_id is null and target is null").join(sy.select("codebase_id", "name"), ["codebase_id", "name"], "left_semi").select("ref_id")
    return a.unionByName(b).unionByName(c).distinct()


JAC = f"""WITH {R}, t AS (SELECT DISTINCT from_symbol AS m, name FROM r WHERE from_symbol >= 1 AND kind IN ('call', 'new', 'type')), n AS (SELECT m, count(*) AS n FROM t GROUP BY 1), q AS (SELECT m FROM n WHERE m % 100 = 0),
 x AS (SELECT a.m AS q, b.m AS m, count(*) AS k FROM t a JOIN t b ON a.name = b.name AND a.m <> b.m WHERE a.m IN (SELECT m FROM q) GROUP BY 1, 2)
 SELECT x.q AS query_id, x.m AS symbol_id, round(k / (nq.n + nm.n - k), 6) AS context FROM x JOIN n nq ON nq.m = x.q JOIN n nm ON nm.m = x.m QUALIFY row_number() OVER (PARTITION BY x.q ORDER BY round(k / (nq.n + nm.n - k), 6) DESC, x.m) <= 10"""


@query(JAC)
def example_context(spark: SparkSession, d: str) -> DataFrame:
    """For every method whose id is divisible by 100, the 10 whose called and created names agree best (Jaccard), by
    joining on names."""
    r = refs(spark, d).where("from_symbol >= 1 and kind in ('call', 'new', 'type')")
    # a method's names and their number in one grouping; both numbers travel with the pairs
    g = r.groupBy(F.col("from_symbol").alias("m")).agg(F.collect_set(F.struct("name")).alias("names"))
    t = g.select("m", F.size("names").alias("n"), F.explode("names.name").alias("name"))
    a = t.where("m % 100 = 0").select(F.col("m").alias("q"), F.col("n").alias("nq"), "name")
    x = a.join(t, "name").where("q <> m").groupBy("q", "m", "nq", "n").agg(F.count(F.lit(1)).alias("k"))
    x = x.withColumn("context", F.round(F.col("k") / (F.col("nq") + F.col("n") - F.col("k")), 6))
    w = Window.partitionBy("q").orderBy(F.desc("context"), "m")
    return x.withColumn("rk", F.row_number().over(w)).where("rk <= 10").select(F.col("q").alias("query_id"), F.col("m").alias("symbol_id"), "context")


# The SQL reads imports line by line, after taking comments out its own way: lines that begin a comment, and what is in blocks.
IMPORTS = r"""WITH f AS (SELECT DISTINCT file_id, codebase_id, path, replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS code FROM code_files WHERE content IS NOT NULL),
 ln AS (SELECT file_id, codebase_id, lower(path) AS p, trim(unnest(string_split(code, chr(10))), ' ' || chr(9)) AS line FROM f)"""


@query(IMPORTS + r""", j AS (SELECT DISTINCT file_id, codebase_id, string_split(rtrim(regexp_replace(split_part(line, '//', 1), '^import\s+', ''), '; '), ' ') AS ws FROM ln WHERE ends_with(p, '.java') AND regexp_matches(line, '^import\s+[\w. *]+;')),
 k AS (SELECT file_id, codebase_id, ws[-1] AS spec, len(ws) > 1 AS st FROM j)
 SELECT DISTINCT file_id, CASE WHEN st THEN 'static' WHEN ends_with(spec, '.*') THEN 'package' ELSE 'type' END AS form, spec FROM k""")
def java_imports_read(spark: SparkSession, d: str) -> DataFrame:
    """Imports read from the text of Java files."""
    return src.imports(files(spark, d).where(F.lower("path").endswith(".java"))).select("file_id", "form", "spec")


@query(IMPORTS + r""", s AS (SELECT DISTINCT file_id, line FROM ln WHERE regexp_matches(p, '\.[cm]?[jt]sx?$')),
 c AS (SELECT DISTINCT file_id, 'from' AS form, regexp_extract(line, 'from\s*["'']([^"'']+)["'']', 1) AS spec FROM s WHERE (starts_with(line, 'import ') OR starts_with(line, 'export ')) AND regexp_matches(line, '^(import|export)\b[^;"''()]*\bfrom\s*["''][^"'']+["'']')
  UNION SELECT DISTINCT file_id, 'bare', regexp_extract(line, '^import\s*["'']([^"'']+)["'']', 1) FROM s WHERE regexp_matches(line, '^import\s*["''][^"'']+["'']')
  UNION SELECT DISTINCT file_id, 'require', unnest(regexp_extract_all(regexp_replace(line, '(^|[^:])//.*$', '\1'), '\brequire\(\s*["'']([^"'']+)["'']\s*\)', 1)) FROM s WHERE NOT starts_with(line, '*') AND NOT starts_with(line, '/*'))
 SELECT form, spec, count(DISTINCT file_id) AS n_files FROM c GROUP BY 1, 2""")
def script_imports(spark: SparkSession, d: str) -> DataFrame:
    """Modules that scripts import, by form."""
    i = src.imports(files(spark, d)).where("form in ('from', 'bare', 'require')")
    return i.groupBy("form", "spec").agg(F.count_distinct("file_id").alias("n_files"))


@query(IMPORTS + r""", pk AS (SELECT file_id, codebase_id, min(rtrim(regexp_replace(line, '^package\s+', ''), '; ')) AS pkg FROM ln WHERE ends_with(p, '.java') AND regexp_matches(line, '^package\s+[\w.]+\s*;') GROUP BY 1, 2),
 own AS (SELECT f.codebase_id, CASE WHEN pkg IS NULL THEN '' ELSE pkg || '.' END || regexp_extract(path, '([^/]+)\.\w+$', 1) AS name, min(f.file_id) AS target_file FROM f LEFT JOIN pk ON pk.file_id = f.file_id WHERE ends_with(lower(path), '.java') GROUP BY 1, 2),
 im AS (SELECT DISTINCT file_id, codebase_id, string_split(rtrim(regexp_replace(split_part(line, '//', 1), '^import\s+', ''), '; '), ' ') AS ws FROM ln WHERE ends_with(p, '.java') AND regexp_matches(line, '^import\s+[\w. *]+;')),
 z AS (SELECT file_id, codebase_id, ws[-1] AS spec, CASE WHEN len(ws) > 1 THEN 'static' ELSE 'type' END AS form FROM im WHERE len(ws) > 1 OR NOT ends_with(ws[-1], '.*'))
 SELECT z.file_id, z.form, z.spec, own.target_file FROM z LEFT JOIN own ON own.codebase_id = z.codebase_id AND own.name = CASE WHEN z.form = 'static' THEN regexp_replace(z.spec, '\.[^.]*$', '') ELSE z.spec END""")
def java_import_links(spark: SparkSession, d: str) -> DataFrame:
    """Java imports linked to the files of the codebase that declare the types."""
    f = files(spark, d)
    return src.link_java_imports(src.imports(f), f)
