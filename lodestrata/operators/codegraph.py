"""Usages, call graphs, type hierarchies, impact and unused code over symbol and reference tables.

References are reduced to what a question needs before they are joined, and pre-aggregated where only counts matter.
Level loops write each level to the shared folder, subtract what was seen, and stop when nothing new comes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Stages

TYPE_KINDS = ("class", "interface", "enum", "record")
CALL_KINDS = ("call", "new", "jsx")


def symbols(df: DataFrame) -> DataFrame:
    """One row per symbol: the last loaded, ties to the smallest file."""
    o = F.struct(F.coalesce(-F.unix_micros(F.col("loaded_at").cast("timestamp")), F.lit(2**63 - 1)).alias("o"), F.col("file_id"))
    cols = [c for c in df.columns if c not in ("symbol_id", "loaded_at")]
    return df.where("symbol_id is not null").groupBy("symbol_id").agg(F.min_by(F.struct(*cols), o).alias("m")).select("symbol_id", "m.*")


def references(df: DataFrame) -> DataFrame:
    """One row per reference."""
    return df.drop("loaded_at").dropDuplicates(["ref_id"])


def certainty() -> Column:
    """linked, by rule, or by name only."""
    return F.when((F.col("via") == "rule") & (F.col("target_id") >= 1), "rule").when(F.col("target_id") >= 1, "linked").otherwise("name")


def usages(refs: DataFrame, syms: DataFrame, supers: DataFrame | None = None) -> DataFrame:
    """(symbol_id, ref_id, how): direct links, links to an overridden member of a supertype, and unlinked references of
    the same name and a compatible number of arguments (-1 fits any)."""
    s = syms.select("symbol_id", "name", "params", "kind", "parent_id", "codebase_id")
    direct = refs.where("target_id >= 1").join(s.select("symbol_id"), F.col("target_id") == F.col("symbol_id")).select("symbol_id", "ref_id", F.when(F.col("via") == "rule", "rule").otherwise("linked").alias("how"))
    # names that symbols bear, once per codebase and name, so that a name's references are counted before they meet symbols
    named = refs.where("target_id is null and target is null and kind in ('call', 'new')").select("ref_id", "codebase_id", "name", "args")
    members = s.where("kind in ('method', 'function')").select(F.col("symbol_id"), F.col("codebase_id").alias("cb"), F.col("name").alias("nm"), "params")
    by_name = named.join(members, (F.col("codebase_id") == F.col("cb")) & (F.col("name") == F.col("nm"))).where("args = -1 or params = -1 or args = params").select("symbol_id", "ref_id", F.lit("name").alias("how"))
    out = direct.unionByName(by_name)
    if supers is not None:
        over = overrides(syms, supers).select(F.col("symbol_id").alias("sub"), F.col("overridden").alias("sup"))
        through = refs.where("target_id >= 1").select("ref_id", "target_id").join(over, F.col("target_id") == F.col("sup")).select(F.col("sub").alias("symbol_id"), "ref_id", F.lit("through").alias("how"))
        out = out.unionByName(through)
    return out.distinct()


def extends_edges(refs: DataFrame, syms: DataFrame) -> DataFrame:
    """(sub, sup): a type and the type it extends or implements. The type is the one enclosing the reference."""
    types = syms.where(F.col("kind").isin(*TYPE_KINDS)).select("symbol_id")
    e = refs.where("kind = 'extends' and target_id >= 1 and from_symbol >= 1").select(F.col("from_symbol").alias("sub"), F.col("target_id").alias("sup")).distinct()
    a = types.select(F.col("symbol_id").alias("a"))
    b = types.select(F.col("symbol_id").alias("b"))
    return e.join(a, F.col("sub") == F.col("a"), "left_semi").join(b, F.col("sup") == F.col("b"), "left_semi").where("sub <> sup")


def closure(edges: DataFrame, a: str, b: str, max_depth: int | None = None) -> DataFrame:
    """(a, b, depth) of all reachable pairs, each with its least depth; loops end because a known pair is never taken again."""
    st = Stages(edges.sparkSession, "closure")
    e = st.put(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct())
    seen = front = st.put(e.where("a <> b").withColumn("depth", F.lit(1)))
    depth = 1
    while max_depth is None or depth < max_depth:
        depth += 1
        step = front.select(F.col("a").alias("x"), F.col("b").alias("y")).join(e, F.col("y") == F.col("a")).select(F.col("x").alias("a"), "b").where("a <> b").distinct()
        new = st.put(step.join(seen.select("a", "b"), ["a", "b"], "left_anti").withColumn("depth", F.lit(depth)))
        if not new.limit(1).count():
            break
        seen, front = seen.unionByName(new), new  # levels are appended, never rewritten
    return seen.select(F.col("a").alias(a), F.col("b").alias(b), "depth")


def overrides(syms: DataFrame, supers: DataFrame) -> DataFrame:
    """(symbol_id, overridden): methods of the same name in a supertype with equal or unknown parameter count."""
    m = syms.where("kind = 'method'")
    sub = m.select("symbol_id", F.col("parent_id").alias("p1"), "name", "params")
    sup = m.select(F.col("symbol_id").alias("overridden"), F.col("parent_id").alias("p2"), F.col("name").alias("n2"), F.col("params").alias("k2"))
    x = sub.join(supers, F.col("p1") == F.col("sub")).join(sup, (F.col("sup") == F.col("p2")) & (F.col("name") == F.col("n2")))
    return x.where("params = k2 or params = -1 or k2 = -1").select("symbol_id", "overridden").distinct()


def call_edges(refs: DataFrame) -> DataFrame:
    """(caller, callee, line): one row per pair with its first line."""
    c = refs.where(F.col("kind").isin(*CALL_KINDS) & (F.col("target_id") >= 1) & (F.col("from_symbol") >= 1) & (F.col("from_symbol") != F.col("target_id")))
    return c.groupBy(F.col("from_symbol").alias("caller"), F.col("target_id").alias("callee")).agg(F.min("line").alias("line"))


def call_tree(edges: DataFrame, roots: DataFrame, depth: int = 4, width: int = 30) -> DataFrame:
    """(root, node, parent, depth, looped): the callers' tree below each root (symbol_id), ``width`` children per node by
    line, stopped where a path would meet itself. Paths are at most ``depth`` long."""
    st = Stages(edges.sparkSession, "calls")
    e = st.put(edges)
    front = roots.select(F.col("symbol_id").alias("root"), F.col("symbol_id").alias("node"), F.array("symbol_id").alias("path"))
    out = None
    for k in range(1, depth + 1):
        x = front.join(e, F.col("node") == F.col("caller")).select("root", F.col("node").alias("parent"), F.col("callee").alias("node"), "line", "path")
        w = Window.partitionBy("root", "path").orderBy("line", "node")
        x = x.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= width)
        x = st.put(x.select("root", "parent", "node", F.array_contains("path", F.col("node")).alias("looped"), F.concat("path", F.array("node")).alias("path")))
        lv = x.select("root", "parent", "node", F.lit(k).alias("depth"), "looped")
        out = lv if out is None else out.unionByName(lv)
        front = x.where("not looped").select("root", "node", "path")
    return out


def impact(edges: DataFrame, roots: DataFrame, max_depth: int = 8, max_nodes: int = 400) -> DataFrame:
    """(root, node, depth, truncated): everything that calls a root, directly or not, with its least depth; of more than
    ``max_nodes`` the nearest, then the smallest ids, and ``truncated`` says so."""
    st = Stages(edges.sparkSession, "impact")
    e = st.put(edges.select("caller", "callee").distinct())
    front = seen = st.put(roots.select(F.col("symbol_id").alias("root"), F.col("symbol_id").alias("node"), F.lit(0).alias("depth")))
    for k in range(1, max_depth + 1):
        step = front.join(e, F.col("node") == F.col("callee")).select("root", F.col("caller").alias("node")).distinct()
        new = st.put(step.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(k)))
        if not new.limit(1).count():
            break
        seen, front = seen.unionByName(new), new  # levels are appended, never rewritten
    w = Window.partitionBy("root").orderBy("depth", "node")
    n = Window.partitionBy("root")
    x = seen.where("depth > 0").withColumn("rk", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(n))
    return x.where(F.col("rk") <= max_nodes).select("root", "node", "depth", (F.col("n") > max_nodes).alias("truncated"))


def call_sites(refs: DataFrame, syms: DataFrame) -> DataFrame:
    """(method, type, name, line, col): calls of known methods and functions from known symbols, with the type they belong to
    (null for functions of no type). Calls from inside the type itself are left out."""
    s = syms.select("symbol_id", "name", "kind", "parent_id")
    t = s.where("kind in ('method', 'function')").select(F.col("symbol_id").alias("t_id"), F.col("name"), F.col("parent_id").alias("type"))
    own = s.select(F.col("symbol_id").alias("o_id"), F.col("parent_id").alias("own"))
    r = refs.where("kind = 'call' and target_id >= 1 and from_symbol >= 1").select("from_symbol", "target_id", "line", "col")
    x = r.join(t, F.col("target_id") == F.col("t_id")).join(own, F.col("from_symbol") == F.col("o_id"), "left")
    return x.where("type is null or own is null or own <> type").select(F.col("from_symbol").alias("method"), "type", "name", "line", "col")


def ordered_pairs(calls: DataFrame, min_sites: int = 3) -> DataFrame:
    """(type, first, second, n): in how many methods a call of one member of a type comes before a call of another, for types
    with at least ``min_sites`` calls from outside.

    Of each member only its first and last place in a method is kept, so a method with many calls of few members stays small;
    pairs are made within one method and one type, whose members are its own.
    """
    c = calls.where("type is not null")
    often = c.groupBy("type").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites).select("type")
    at = F.struct("line", "col")
    f = c.join(often, "type", "left_semi").groupBy("method", "type", "name").agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    x = f.select("method", "type", F.col("name").alias("first"), "lo").join(f.select("method", "type", F.col("name").alias("second"), "hi"), ["method", "type"])
    return x.where("first <> second and lo < hi").groupBy("type", "first", "second").agg(F.count(F.lit(1)).alias("n"))


def association_rules(rows: DataFrame, group: str, item: str, min_support: int = 3, min_confidence: float = 0.8) -> DataFrame:
    """(antecedent, consequent, support, confidence): pairs of items that share groups, in the direction of the higher
    confidence, ties to the alphabetical first. Infrequent items go before pairing."""
    x = rows.select(group, item).distinct()
    n = x.groupBy(item).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_support)
    f = x.join(n.select(item), item, "left_semi")
    a = f.select(F.col(group).alias("g"), F.col(item).alias("a"))
    b = f.select(F.col(group).alias("h"), F.col(item).alias("b"))
    p = a.join(b, (F.col("g") == F.col("h")) & (F.col("a") < F.col("b"))).groupBy("a", "b").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= min_support)
    p = p.join(n.select(F.col(item).alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col(item).alias("b"), F.col("n").alias("nb")), "b")
    ab = F.col("na") <= F.col("nb")
    conf = F.col("support") / F.least("na", "nb")
    return p.where(conf >= min_confidence).select(F.when(ab, F.col("a")).otherwise(F.col("b")).alias("antecedent"), F.when(ab, F.col("b")).otherwise(F.col("a")).alias("consequent"), "support", F.round(conf, 2).alias("confidence"))


def missing_companions(rows: DataFrame, group: str, item: str, rules: DataFrame) -> DataFrame:
    """(group, antecedent, consequent): groups that hold a rule's first item without its second."""
    x = rows.select(group, item).distinct()
    has = x.join(rules.select(F.col("antecedent").alias(item), "consequent"), item).select(group, F.col(item).alias("antecedent"), "consequent")
    return has.join(x.withColumnRenamed(item, "consequent"), [group, "consequent"], "left_anti").select(group, "antecedent", "consequent")


def suffixes(names: DataFrame, group: str, name: str, min_share: float = 0.6, min_names: int = 2) -> DataFrame:
    """(group, suffix, n, total): the capitalised suffix that at least ``min_share`` of a group's names end in; the most
    covering, then the longest, then the first."""
    d = names.select(group, name)
    parts = F.regexp_extract_all(F.col(name), F.lit("([A-Z][a-z0-9]+|[A-Z]+(?![a-z]))"), F.lit(1))
    x = d.withColumn("parts", parts).where(F.size("parts") > 0)
    tails = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.array_join(F.slice("parts", i, F.size("parts")), ""))
    x = x.select(group, F.explode(tails).alias("suffix")).groupBy(group, "suffix").agg(F.count(F.lit(1)).alias("n"))
    t = d.groupBy(group).agg(F.count(F.lit(1)).alias("total")).where(F.col("total") >= min_names)
    x = x.join(t, group).where(F.col("n") >= min_share * F.col("total"))
    w = Window.partitionBy(group).orderBy(F.desc("n"), F.desc(F.length("suffix")), "suffix")
    return x.withColumn("rk", F.row_number().over(w)).where("rk = 1").drop("rk")


def folders(files: DataFrame, flag: str, path: str = "path", share: float = 0.8) -> DataFrame:
    """(folder, n, flagged): topmost folders in which at least ``share`` of the files are flagged. Counts roll up to every
    ancestor; a folder below a chosen one is left out."""
    parts = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    up = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.array_join(F.slice("parts", 1, i), "/"))
    x = files.select(F.col(flag).cast("int").alias("f"), parts.alias("parts")).where(F.size("parts") > 0)
    c = x.select("f", F.explode(up).alias("folder")).groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.sum("f").alias("flagged")).where(F.col("flagged") >= share * F.col("n"))
    parents = F.split("folder", "/")
    anc = F.transform(F.sequence(F.lit(1), F.size(parents) - 1), lambda i: F.array_join(F.slice(parents, 1, i), "/"))
    below = c.where(F.size(parents) > 1).select("folder", F.explode(anc).alias("above")).join(c.select(F.col("folder").alias("above")), "above", "left_semi").select("folder").distinct()
    return c.join(below, "folder", "left_anti")


def layers(edges: DataFrame) -> DataFrame:
    """(package, n_out, n_in, rank_key): how many other packages one uses and is used by; high keys are upper layers."""
    e = edges.select("src", "dst").where("src <> dst").distinct()
    o = e.groupBy(F.col("src").alias("package")).agg(F.count(F.lit(1)).alias("n_out"))
    i = e.groupBy(F.col("dst").alias("package")).agg(F.count(F.lit(1)).alias("n_in"))
    return o.join(i, "package", "full").select("package", F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("n_in", F.lit(0)).alias("n_in")).withColumn("rank_key", F.col("n_out") - F.col("n_in"))


def unused(syms: DataFrame, refs: DataFrame) -> DataFrame:
    """(symbol_id, by_name): methods and functions nothing links to from outside themselves, that no import names and
    that are no entry points; with the number of unlinked references that bear their name."""
    m = syms.where("kind in ('method', 'function')")
    linked = refs.where("target_id >= 1 and (from_symbol is null or from_symbol <> target_id)").select(F.col("target_id").alias("symbol_id")).distinct()
    imported = refs.where("kind = 'import'").select("codebase_id", "name").distinct()
    entry = F.col("name").rlike(r"^(main|run|setUp|tearDown|test[A-Z].*|on[A-Z].*|handle[A-Z].*|use[A-Z].*|ng[A-Z].*|init|constructor)$")
    names = refs.where("target_id is null and target is null").groupBy("codebase_id", "name").agg(F.count(F.lit(1)).alias("by_name"))
    x = m.where(~entry).join(linked, "symbol_id", "left_anti").join(imported, ["codebase_id", "name"], "left_anti")
    return x.join(names, ["codebase_id", "name"], "left").select("symbol_id", F.coalesce("by_name", F.lit(0)).alias("by_name"))


def normal_path(c: Column | str) -> Column:
    """A route or URL without scheme, host, query and fragment, its variables as {}, without leading {}."""
    p = F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"^[a-z]+://[^/]*", "")
    p = F.regexp_replace(p, r"[?#].*$", "")
    p = F.regexp_replace(p, r"\$\{[^}]*\}|\{[^}]*\}|:[A-Za-z_]\w*|<[^>/]+>", "{}")
    p = F.regexp_replace(p, r"/+$", "")
    return F.regexp_replace(p, r"^(/?\{\})+", "")


def match_routes(servers: DataFrame, clients: DataFrame) -> DataFrame:
    """(server_id, client_id) where a client's path reaches a server's route: equal segments, {} fits any, and of paths
    of unequal length the shorter is the longer's tail with at least two segments; a tail of wildcards alone never fits.

    The join is on tail length and its last literal segment with its place from the end, so it is an equality join.
    """

    def tails(df: DataFrame, who: str) -> DataFrame:
        seg = F.filter(F.split("path", "/"), lambda s: s != "")
        x = df.select(F.col("id").alias(who), F.upper("method").alias(who + "_m"), seg.alias(who + "_s")).where(F.size(seg) > 0)
        return x

    s, c = tails(servers, "server"), tails(clients, "client")
    # every literal of the server's path, keyed by its place from the end
    key = lambda col: F.filter(F.transform(col, lambda v, i: F.struct((F.size(col) - i).alias("p"), v.alias("v"))), lambda z: z["v"] != "{}")
    a = s.select("*", F.explode(key(F.col("server_s"))).alias("k")).select("server", "server_m", "server_s", F.col("k.p").alias("p"), F.col("k.v").alias("v"))
    b = c.select("*", F.explode(key(F.col("client_s"))).alias("k")).select("client", "client_m", "client_s", F.col("k.p").alias("p"), F.col("k.v").alias("v"))
    j = a.join(b, ["p", "v"]).drop("p", "v").distinct()
    n, m = F.size("server_s"), F.size("client_s")
    k = F.least(n, m)
    pairs = F.zip_with(F.slice("server_s", n - k + 1, k), F.slice("client_s", m - k + 1, k), lambda x, y: (x == y) | (x == "{}") | (y == "{}"))
    ok = F.forall(pairs, lambda x: x) & ((n == m) | (k >= 2)) & ((F.col("server_m") == F.col("client_m")) | F.col("server_m").isNull() | F.col("client_m").isNull())
    return j.where(ok).select(F.col("server").alias("server_id"), F.col("client").alias("client_id")).distinct()


TEST_PATH = r"(?i)(^|/)(tests?|__tests__|spec|specs|testing)(/|$)|[._-](test|spec)\.\w+$|(Test|Tests|IT|Spec)\.\w+$"


def is_test(path: Column | str) -> Column:
    """Whether a path is a test's: a test folder, or a file name marked as one."""
    return F.coalesce((F.col(path) if isinstance(path, str) else path).rlike(TEST_PATH), F.lit(False))


def resolve_relative(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (file_id, codebase_id, path, spec) -> (file_id, spec, target_file): relative module names, with any number of
    ``..``, resolved against the importing file's folder and the codebase's files: the name itself, with a known extension, a
    folder's index file, or a TypeScript file for a name that ends in a JavaScript extension; the first that exists, or null.
    Names that lead out of the codebase resolve to nothing."""
    steps = F.filter(F.split(F.concat(F.regexp_replace("path", r"[^/]*$", ""), "spec"), "/"), lambda x: (x != "") & (x != "."))
    state = F.struct(F.expr("cast(array() as array<string>)").alias("at"), F.lit(True).alias("ok"))
    up = lambda a, x: F.struct(
        F.when(x == "..", F.slice(a["at"], F.lit(1), F.greatest(F.lit(0), F.size(a["at"]) - 1))).otherwise(F.array_append(a["at"], x)).alias("at"), (a["ok"] & ((x != "..") | (F.size(a["at"]) > 0))).alias("ok")
    )
    x = imports.select("file_id", "codebase_id", "spec", F.aggregate(steps, state, up).alias("s")).where("s.ok")
    x = x.select("file_id", "codebase_id", "spec", F.array_join("s.at", "/").alias("base")).distinct()
    bare = F.regexp_replace("base", r"\.[cm]?jsx?$", "")
    ends = ["", ".ts", ".tsx", ".mts", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
    tries = [F.struct(F.lit(i).alias("rank"), F.concat("base", F.lit(e)).alias("path")) for i, e in enumerate(ends)]
    tries += [F.when(bare != F.col("base"), F.struct(F.lit(len(ends) + i).alias("rank"), F.concat(bare, F.lit(e)).alias("path"))) for i, e in enumerate([".ts", ".tsx", ".mts"])]
    c = x.select("file_id", "codebase_id", "spec", F.explode(F.filter(F.array(*tries), lambda t: t.isNotNull())).alias("t"))
    f = files.select("codebase_id", F.col("path").alias("f_path"), F.col("file_id").alias("f_id")).groupBy("codebase_id", "f_path").agg(F.min("f_id").alias("f_id"))
    hit = c.join(f.withColumnRenamed("codebase_id", "f_base"), (F.col("codebase_id") == F.col("f_base")) & (F.col("t.path") == F.col("f_path")))
    best = hit.groupBy("file_id", "spec").agg(F.min_by("f_id", "t.rank").alias("target_file"))
    return imports.select("file_id", "spec").distinct().join(best, ["file_id", "spec"], "left")
