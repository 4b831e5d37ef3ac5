"""Code graph, document rules, tables, sources and sinks on small fixtures."""

import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import codegraph as cg
from lodestrata.operators import documents as do
from lodestrata.sources import files as src
from lodestrata.streaming import events as ev


def test_closure_and_impact(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "caller long, callee long")
    got = {(r[0], r[1], r[2]) for r in cg.closure(e, "caller", "callee").collect()}
    assert (4, 3, 3) in got and (1, 3, 2) in got and all(a != b for a, b, _ in got)
    imp = {(r["node"], r["depth"]) for r in cg.impact(e, spark.createDataFrame([(3,)], "symbol_id long")).collect()}
    assert imp == {(2, 1), (1, 2), (4, 3)}
    cut = cg.impact(e, spark.createDataFrame([(3,)], "symbol_id long"), max_nodes=2).collect()
    assert len(cut) == 2 and all(r["truncated"] for r in cut)


def test_call_tree_stops_in_loops(spark):
    e = spark.createDataFrame([(1, 2, 5), (2, 1, 1)], "caller long, callee long, line int")
    t = cg.call_tree(e, spark.createDataFrame([(1,)], "symbol_id long")).collect()
    assert [(r["node"], r["depth"], r["looped"]) for r in sorted(t, key=lambda r: r["depth"])] == [(2, 1, False), (1, 2, True)]


def test_routes(spark):
    s = spark.createDataFrame([(1, "get", "/api/items/{}"), (2, "post", "/api/items"), (3, "get", "/{}")], "id long, method string, path string")
    c = spark.createDataFrame([(10, "GET", "/v1/api/items/{}"), (11, "GET", "/api/items"), (12, None, "/api/items/7"), (13, "GET", "/items")], "id long, method string, path string")
    assert {tuple(r) for r in cg.match_routes(s, c).collect()} == {(1, 10), (1, 12)}
    p = spark.createDataFrame([("https://h/a/${x}/b?q=1",), ("/:id/c/",), ("/a/<n>",)], "p string").select(cg.normal_path("p")).collect()
    assert [r[0] for r in p] == ["/a/{}/b", "/c", "/a/{}"]


def test_rules_and_folders(spark):
    rows = [(g, i) for g in range(5) for i in "ab"] + [(9, "b"), (1, "c")]
    r = cg.association_rules(spark.createDataFrame(rows, "g long, i string"), "g", "i").collect()
    assert [tuple(x) for x in r] == [("a", "b", 5, 1.0)]
    f = spark.createDataFrame([("t/x/a", True), ("t/x/b", True), ("t/y/c", True), ("m/d", False), ("e", True)], "path string, flag boolean")
    assert [r["folder"] for r in cg.folders(f, "flag").collect()] == ["t"]


def test_provisions_numbers_and_captions(spark):
    t = ["NOTE shall", "It shall", "it should", "it may", "May it", "x", None]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in t], "text string").select(do.provision("text")).collect()] == ["note", "requirement", "recommendation", "permission", "", "", ""]
    n = spark.createDataFrame([("12.0",), ("1,000",), ("1,5",), ("007",)], "s string").select(do.number(F.col("s"))).collect()
    assert [r[0] for r in n] == ["12", "1000", "1.5", "007"]
    c = do.caption("text")
    r = spark.createDataFrame([("Table 3-1. Codes - Continued",), ("Figure 2 Flow",), ("None",)], "text string").select(*[v.alias(k) for k, v in c.items()]).collect()
    assert tuple(r[0]) == ("table", "3-1", "Codes", True) and r[1]["kind"] == "figure" and r[2]["kind"] == ""


def test_parent_keys(spark):
    k = spark.createDataFrame([("K3",), ("K3.5",), ("K3.51",), ("K3.5A",)], "key string")
    assert {tuple(r) for r in do.parent_keys(k).collect()} == {("K3.5", "K3"), ("K3.51", "K3"), ("K3.5A", "K3.5")}


def test_editions(spark):
    s = "pair long, num string, title string, text string"
    old = spark.createDataFrame([(1, "1", "Scope", "a b c d"), (1, "2", "Use", "one two three four"), (1, "3", "", "gone entirely now"), (1, "4", "", "x y z w v")], s)
    new = spark.createDataFrame([(1, "2", "Scope", "a b c d"), (1, "1", "Use", "one two three five"), (1, "7", "", "x y z w u"), (1, "8", "", "brand new words")], s)
    got = {(r["old_num"], r["new_num"], r["status"]) for r in do.compare_editions(old, new).collect()}
    assert got == {("1", "2", "renumbered"), ("2", "1", "changed"), ("3", None, "removed"), ("4", "7", "changed"), (None, "8", "added")}
    assert do.word_diff("a b c", "a x c") == "a <del>b</del> <ins>x</ins> c"


def test_tables(spark):
    cells = [("t", r, 0, str(r)) for r in range(5)] + [("t", r, 1, f"K{r}.1") for r in range(5)] + [("t", r, 2, "two words") for r in range(5)] + [("t", 0, 3, "")]
    got = {r["col"]: r["class"] for r in do.classify_columns(spark.createDataFrame(cells, "table_id string, row int, col int, value string")).collect()}
    assert got == {0: "number", 1: "code", 2: "words"}
    f = spark.createDataFrame([("t", 1, 4, 0), ("t", 2, 2, 6), ("t", 3, 1, 7)], "g string, o int, w int, at0 int")
    assert [(r["at"], r["gap"], r["overlaps"]) for r in do.layout(f, "g", "o", "w", "at0").orderBy("o").collect()] == [(0, 2, False), (6, -1, True), (7, 0, False)]
    assert [c[:2] for c in do.chunks([["a" * 50]] * 5, "cap", 110)] == [(0, 1), (2, 3), (4, 4)]
    assert "ON_OFF_2(" in do.render_enum("Mode", [("on/off", "1"), ("On off", "2")]) and do.field_name("3 way Valve") == "f3WayValve"


def test_manifests_aliases_templates():
    assert src.manifest("package.json", '{"dependencies": {"a": "1"}, "devDependencies": {"b": "^2"}}') == [("npm", "a", "1", "runtime"), ("npm", "b", "^2", "dev")]
    pom = '<project xmlns="x"><properties><v>3</v></properties><dependencyManagement><dependencies><dependency><groupId>no</groupId></dependency></dependencies></dependencyManagement><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>${v}</version></dependency></dependencies></project>'
    assert src.manifest("pom.xml", pom) == [("maven", "g:a", "3", "compile")]
    assert src.manifest("build.gradle", "  implementation 'g:a:1'\n  testImplementation(\"h:b\")") == [("maven", "g:a", "1", "implementation"), ("maven", "h:b", "", "testImplementation")]
    assert src.manifest("package.json", "{broken") == []
    assert src.aliases('{ // c\n "compilerOptions": {"baseUrl": "./src", "paths": {"@/*": ["app/*",],},},}') == {"@/*": ["src/app/*"]}
    assert src.relaxed_json('[1, "a // b, ]", /* x, */ {"k\\"": null,}, // end\n]') == [1, "a // b, ]", {'k"': None}]
    assert src.aliases("{ /* open") == {} and src.aliases("[]") == {} and src.aliases('{"compilerOptions": {}}') == {}
    assert src.template('<my-card [title]="name" (click)="save()">{{ total }}</my-card>') == [("component", "my-card", 1), ("member", "name", 1), ("handler", "save", 1), ("member", "total", 1)]
    assert src.as_text(b"\xef\xbb\xbfa\r\nb") == ("a\nb", "utf-8-sig+crlf")


def small_class() -> bytes:
    utf = lambda s: b"\x01" + struct.pack(">H", len(s)) + s.encode()
    pool = [utf("p/Tiny"), b"\x07\x00\x01", utf("java/lang/Object"), b"\x07\x00\x03", utf("add"), utf("(I[Ljava/lang/String;)J")]
    return b"\xca\xfe\xba\xbe" + struct.pack(">HHH", 0, 52, len(pool) + 1) + b"".join(pool) + struct.pack(">HHHH", 1, 2, 4, 0) + struct.pack(">H", 0) + struct.pack(">H", 1) + struct.pack(">HHHH", 9, 5, 6, 0) + struct.pack(">H", 0)


def test_class_files_and_jars(spark, tmp_path):
    assert src.descriptor("(I[Ljava/lang/String;)J") == (["int", "java.lang.String[]"], "long")
    with zipfile.ZipFile(tmp_path / "a.jar", "w") as z:
        z.writestr("p/Tiny.class", small_class())
        z.writestr("x.txt", "no")
    rows = {(r["qualified"], r["kind"], r["params"], r["returns"], r["is_static"]) for r in src.library(spark, str(tmp_path)).collect()}
    assert rows == {("p.Tiny", "class", -1, "", False), ("p.Tiny#add", "method", 2, "long", True)}
    assert src.class_file(b"nope") is None


def test_source_tree_and_history(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.ts").write_bytes(b"let a;\r\n")
    (tmp_path / "node_modules" / "b.ts").write_text("x")
    (tmp_path / "src" / "c.bin").write_text("x")
    assert [(r["path"], r["language"], r["lines"], r["content"]) for r in src.source_tree(spark, str(tmp_path)).collect()] == [("src/a.ts", "typescript", 1, "let a;\n")]
    (tmp_path / "h.log").write_text("commit\tc1\tann\t2024-01-01\n3\t1\tsrc/a.ts\n-\t-\tlogo.png\n")
    spark.dataSource.register(src.HistorySource)
    got = spark.read.format("commit_log").option("path", str(tmp_path)).load().collect()
    assert [tuple(r) for r in got] == [("c1", "ann", "2024-01-01", "src/a.ts", 3, 1), ("c1", "ann", "2024-01-01", "logo.png", None, None)]


def test_markdown_and_csv(spark, tmp_path):
    df = spark.createDataFrame([("a|b", "x\ny", None)], "p string, q string, r string")
    assert src.markdown_rows(df, ["p", "q", "r"]).first()["line"] == "| a\\|b | x y |  |"
    src.write_csv(df, str(tmp_path / "o"))
    assert spark.read.option("header", True).csv(str(tmp_path / "o")).columns == ["p", "q", "r"]


def test_upsert_is_idempotent(spark):
    a = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "z")], "k long, t long, v string")
    s = ev.upsert(None, a, ["k"], ["t"])
    again = ev.upsert(s, a, ["k"], ["t"])
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, again.collect())) == [(1, 2, "y"), (2, 1, "z")]


@pytest.mark.parametrize("edges", [[], [(1, 2)]])
def test_closure_small(spark, edges):
    assert cg.closure(spark.createDataFrame(edges, "a long, b long"), "a", "b").count() == len(edges)


def test_plans_push_down(spark, tmp_path):
    spark.range(100).select("id", F.lit("java.util.List#add").alias("target"), F.lit(1).alias("wide")).write.parquet(str(tmp_path / "r"))
    x = spark.read.parquet(str(tmp_path / "r")).where(F.col("target").startswith("java.util.")).select("id")
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(target,java.util.)" in plan and "wide" not in plan.split("ReadSchema")[1]


def test_research_functions(spark):
    from lodestrata.operators import research as re_

    assert re_.parameter_types("Map<String, List<A>> f(final Map<String, int[]> m, @N A... xs)") == ["Map<String, int[]>", "A..."]
    assert re_.parameter_types("function g(a: Record<string, () => void>, b?: number, c): T") == ["Record<string, () => void>", "number", ""]
    assert re_.parameter_types("field x") == [] and re_.parameter_types(None) == []
    assert re_.lcs_share("abcd", "axcd") == 0.75 and re_.lcs_share("", "") == 1.0
    assert [round(x[2], 3) for x in re_.align("The pump is open and the valve is shut now.", "Nothing like it at all here, truly. The pump is open and the valve is shut now.")] == [1.0]
    c = re_.components(spark.createDataFrame([(1, 2), (3, 2), (9, 8), (5, 5)], "a long, b long"), "a", "b")
    assert {tuple(r) for r in c.collect()} == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8), (5, 5)}
    v = re_.embed(spark.createDataFrame([(1, "red pump"), (2, "blue"), (3, None)], "id long, text string"), "text")
    n = re_.nearest(v, "id", {7: re_.hashed_bag(["pump red"])[0]}, floor=0.5).collect()
    assert [(r["qid"], r["id"], round(r["sim"], 3)) for r in n] == [(7, 1, 1.0)]
    e = spark.createDataFrame([("Doc A", "1.2", None), ("Doc A", "3", None)], "document string, clause string, page string")
    ok = e.select(re_.agrees({"document": F.lit("The doc a"), "clause": F.lit("1.2"), "page": F.lit("5")}, {k: F.col(k) for k in ("document", "clause", "page")}).alias("ok")).collect()
    assert [r["ok"] for r in ok] == [True, False]


def test_links_and_outlines(spark):
    from lodestrata.operators import research as re_

    ln = spark.createDataFrame([(1, "goto", 1, 4, "Table 1", False), (2, "goto", 1, 5, "table 1", False), (3, "uri", 1, None, None, False), (4, "goto", 1, None, "Table 1", True), (5, "goto", 1, 2, "Table 9", False)], "link_id long, kind string, doc_id long, target_page int, expected_label string, dead boolean")
    t = spark.createDataFrame([(1, "Table 1", 4)], "doc_id long, label string, page int")
    assert {tuple(r) for r in re_.link_state(ln, t).collect()} == {(1, "ok"), (2, "wrong"), (3, "external"), (4, "dead"), (5, "unresolved")}
    toc = spark.createDataFrame([(1, 1, "Scope!", "1"), (1, 2, "Old name", "2"), (1, 3, "None", "")], "doc_id long, entry long, text string, num string")
    h = spark.createDataFrame([(1, 10, "scope", "7"), (1, 11, "New name", "2")], "doc_id long, block_id long, text string, num string")
    assert {(r["entry"], r["block_id"], r["how"]) for r in re_.match_outline(toc, h).collect()} == {(1, 10, "text"), (2, 11, "number"), (3, None, "none")}


def test_clauses_acronyms_and_findings(spark):
    rows = [(1, 1, "1 Scope"), (1, 2, "see 2 apples."), (1, 3, "2.1 Use of it"), (1, 4, "9.9 Far away"), (1, 5, "3 Limits"), (2, 1, "12 Too high"), (2, 2, None)]
    got = {(r["doc_id"], r["num"]) for r in do.clauses_of(spark.createDataFrame(rows, "doc_id long, seq int, text string")).collect()}
    assert got == {(1, "1"), (1, "2.1"), (1, "3")}
    b = spark.createDataFrame([(1, 1, 10, "The Global Control Unit (GCU) and Some Thing (XX)."), (1, 2, 11, "Good Chief Uncle (GCU)")], "doc_id long, seq int, block_id long, text string")
    assert [tuple(r) for r in do.acronyms(b).collect()] == [(1, "GCU", "Global Control Unit")]
    q = do.quantities(spark.createDataFrame([(1, "in 10 seconds and 1.50 mm"), (2, "in 12 seconds and 1,5 mm"), (3, None)], "block_id long, text string"))
    assert {tuple(r) for r in q.collect()} == {(1, "seconds", "10"), (1, "mm", "1.5"), (2, "seconds", "12"), (2, "mm", "1.5")}
    f = do.assess(spark.createDataFrame([(1, 2)], "a long, b long"), q, spark.createDataFrame([(1, 3), (2, 1)], "block_id long, strength int"))
    assert {tuple(r) for r in f.collect()} == {(1, 2, "values"), (1, 2, "weaker")}


def test_similar_texts_equal_all_pairs():
    """The word bounds lose no similar pair: against the alignment of all pairs."""
    import random
    from collections import Counter

    rng = random.Random(3)
    words = [f"w{i}" for i in range(14)]
    a = {str(i): " ".join(rng.choice(words) for _ in range(rng.randrange(0, 12))) for i in range(60)}
    b = {str(i): " ".join(w for w in a[str(i)].split() if rng.random() > 0.2) if i % 2 else " ".join(rng.choice(words) for _ in range(rng.randrange(0, 12))) for i in range(60)}
    texts = do.Texts(b)
    got = {(x, y, round(s, 9)) for x, t in a.items() for y, s in texts.similar(t.split(), Counter(t.split()), 0.6)}
    want = {(x, y, round(do.difflib.SequenceMatcher(None, t.split(), u.split(), autojunk=False).ratio(), 9)) for x, t in a.items() for y, u in b.items()}
    assert got == {w for w in want if w[2] >= 0.6}


def test_imports_beside_long_strings(spark):
    long = ["'" + "x" * 300_000 + "'", '"' + r"\"x" * 100_000 + '"', "`" + "// no\n" * 50_000 + "`", '"' + "y" * 300_000]
    rows = [(k, 1, f"a/f{k}.ts", f"import {{ a }} from './a';\nconst t = {t};\n// import './c';\nimport './b{k}';\n") for k, t in enumerate(long)]
    got = {(r["file_id"], r["form"], r["spec"]) for r in src.imports(spark.createDataFrame(rows, "file_id long, codebase_id long, path string, content string")).collect()}
    assert got == {(k, "from", "./a") for k in range(4)} | {(k, "bare", f"./b{k}") for k in range(4)}
