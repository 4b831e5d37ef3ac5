"""Syntax, origin and neighbours on stated cases and against brute force."""

import pickle
import random
import re
import threading

import numpy as np
import psutil
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import lexing, neighbours, origin, syntax

JAVA = """package a.b; import java.util.*; import static x.Y.z;
@Deprecated(since = "1", forRemoval = true) public sealed class C<T extends Comparable<T> & Runnable> extends D<List<Map<String, int[]>>> implements E permits F, G {
  static { int x = 1; } { y(); }
  private final Map<String, List<T>>[] m = new Map[3]; int a, b[] = {1, 2,}, c;
  public <R> C(@Nullable T t, int... n) throws IOException { super(t); this.<R>go(); }
  abstract void go(); default int q() { return a > b ? 1 : -1 >>> 2; }
  enum Z implements I { A(1) { void f() {} }, B; Z(int... i) {} } record P(int x, T... y) { P { if (x < 0) throw new E("" + x); } }
  @interface An { int v() default 3; String[] w() default {}; }
  Object f(Object o) { for (int i = 0, j; i < 3; i++, j--) ; for (var e : list) continue; l: while (true) break l; do x++; while (x < 1);
    try (var r = open(); s) { a.b().c[1] = (int) 2.5e3f; } catch (A | B e) { } finally { }
    synchronized (this) { assert x : "m"; } Runnable r = () -> { }; Function<A, B> g = (final A a) -> a::b; var s = int[]::new; List<String>[] ls = null;
    String t = \"\"\"
      text "quoted" \\n
      \"\"\"; char c = '\\u0041', d = '\\'';
    return switch (o) { case Integer i when i > 3 -> i; case P(int x, var y) -> { yield x; } case null, default -> throw new X(); }; }
  int g(int k) { switch (k) { case 1: case 2: return 1; default: } if (o instanceof final String s && !s.isEmpty()) return (T) (Object) s.length(); new Foo<>() { int z; }.bar(); int yield_ = x << 2 >> 1; return ~x; }
}"""
JS = """#!/usr/bin/env node
import d, { a as b, default as c } from "x"; import * as n from './y.js'; import 'z'; export * from "q"; export { a, b as default }; export default class extends X { }
'use strict'; var x = 1, { y = 2, ...z } = o, [p, , ...q] = r; let async = 1, of = 2; const f = async (a, { b } = {}, ...c) => ({ a, b }), g = x => x / 2 / 3, re = /[/\\]"']+/gi.test(s)
function* gen() { yield; yield* a; const v = yield b } async function h() { for await (const e of it) await e; }
class A extends (B, C) { static #p = 1; #q() { return #p in this } get x() { return 1 } set x(v) { } static { a() } async *m() { } 'str'() { } [k] = 2; static async = 1; get; z }
label: for (var i in o) { if (a) continue label; else break }
if (a) /re/.exec(b); else do x++; while (x < 3) switch (x) { case 1: default: { } }
a ? b : c ? (d, e) : f; !function () { }(); (() => { })(); new (foo())(1).bar`t${a + `n${b}`}x`; x ??= y?.z?.[0]?.(1) ?? 2 ** 3; delete a.b, void 0, typeof c
try { throw a } catch { } finally { } ({ a, b() { }, get c() { return 1 }, async d() { }, *e() { }, [f]: 1, 'g': 2, 3: 4, ...h });[a, b] = [b, a]; ({ a, b } = c)
var re2 = a++ / 2, s = `a
b`; return
x
"""
JSX = """const V = ({ items }) => (<><ul className="a" {...p} on={() => { go() }}>{items.map((i) => (<li key={i.id} t="x >">{i.n} of the X's list{/* c */}</li>))}<A.B c:d="e" /></ul></>);
const t = a < b ? <p>it's &amp; done</p> : null;"""
TS = """import type { A } from "a"; import B, { type C, D as E } from 'b'; import fs = require("fs"); export type { A }; export = x;
enum Color { Red, Green = 'g' } const enum K { A = 1 << 2 } declare module "m" { export function f(a: number): string; } declare global { interface Window { x: any } } namespace N.M { export const a = 1 }
interface I<T = {}> extends J<T>, K { (a: T): void; new (x: number): I; readonly [k: string]: unknown; m?(a?: number, ...r: string[]): asserts a is string; get z(): number; p: { a: 1 } | null }
type U<T> = T extends (infer R extends string)[] ? { readonly [K in keyof T]?: T[K] } : typeof x.y | `a${string}` | [a: number, b?: string, ...c: X[]] | (new () => T) | ((a: T) => a is string) | unique symbol | -1;
abstract class C<T> extends D<T> implements I, J<T> { private readonly a: number = 1; static b?: string; declare c: T; protected constructor(public x: number, private y?: string) { super() } abstract m(): void; get v(): T { return this.a as unknown as T } foo<K extends keyof T>(k: K, cb: (e: Error | null) => void): asserts k; foo(k: any) { } @dec() p!: number; override async *q(): AsyncGenerator<T> { } }
function isS(x: unknown): x is string { return typeof x === "string" && /^[a-z]{2,4}$/.test(x) } function over(a: string): void; function over(a: any) { }
const f = async <T,>(a: T, b = 1): Promise<Array<Map<string, T>>> => { const out = { ...a } satisfies X; return out! }, g = <T>(x: T) => x, h = <any>y, m = new Map<string, number[]>(), z = a < b, w = foo<string>(1), q = x!.y![0]; let v: Record<string, () => void> = {}
for (const [k, v] of Object.entries<number>(o)) { } export abstract class Q { } export default interface R { a: string } type T2 = A["b"][]; let o2 = { m<T>(a: T): void { }, async n() { } }
"""


@pytest.mark.parametrize(("path", "text"), [("A.java", JAVA), ("a.js", JS), ("a.jsx", JSX), ("a.ts", TS), ("a.tsx", JSX + "const f = <T,>(x: T): T => x; const g = x as string;"), ("a.mjs", ""), ("a.ts", "﻿let a: number\r\nlet b\r\n"), ("A.java", "// only\n"), ("x.txt", "((("), ("a.cjs", None), ("e.java", "package a;\n\n/* =======\n<<<<<<< x */\nclass A {}")])
def test_valid(path, text):
    assert syntax.first_error(path, text) is None


BAD = {
    "A.java": ["class A { void f( { } }", "class A { int x = ; }", "class A { void f() { a + b; } }", "class A {", "clas A { }", "class A { String s = \"x; }", "class A { void f() {} } }", "class A {\n<<<<<<< HEAD\n int a;\n}", "<html></html>", "class A { void f() { fix this later please } }", "import os\n\ndef f(x):\n    return 1", "class A { int f() { return 1 } }"],
    "a.js": ["let x = ;", "function f( {", "a b", "if (x {}", "const a = [1, 2;", "x = {a: 1", "foo(1,, 2)", "var a = `x", "<<<<<<< a\nx", "{\n  \"a\": 1,\n  \"b\": [1]\n}", "type A = string;", "class A { x( }", "let a: number = 1", "1 + = 2", "asdf ]] ;", "interface A { b: string }", "return )", "a => { ]"],
    "a.ts": ["let x: = 1", "interface A { b: }", "type A 3", "class A { m(: string) {} }", "const a = <div>x</div>;", "function f(a: number { }", "enum { }", "steps:\n  - run: make a\n  - run: b --all"],
    "a.tsx": ["const a = <div><b></div>;", "const a = <div>;", "const x = <p a=>y</p>"],
}


@pytest.mark.parametrize(("path", "text"), [(p, t) for p, ts in BAD.items() for t in ts])
def test_invalid(path, text):
    assert syntax.first_error(path, text) is not None


def test_every_truncation_is_found():
    for path, text in (("A.java", JAVA), ("a.ts", TS)):
        kind = syntax.kind_of(path)
        toks = lexing.lex(text, kind)
        depth = 0
        for i, t in enumerate(toks[:-1]):
            depth += (t in "{[(") - (t in "}])") if len(t) == 1 else 0
            if depth and i % 7 == 0:
                assert syntax.first_error(path, text[: toks.to[i]]) is not None, text[: toks.to[i]][-60:]


def test_deep_and_long():
    assert syntax.first_error("a.js", "x = " + "(" * 3000 + "1" + ")" * 3000) is None
    assert syntax.first_error("a.js", "x = [" + "1," * 60_000 + "];") is None
    assert syntax.first_error("a.js", "x = [" + "1," * 60_000 + ";")[0] == 1


def test_errors_table(spark):
    rows = [(1, "a.js", "let x = ;", 5), (1, "a.js", "let x = ;", 5), (2, "a.js", "let x", 5), (3, "b.py", "(", 5), (4, None, "(", 5), (5, "a.ts", None, 5)]
    out = syntax.syntax_errors(spark.createDataFrame(rows, "file_id long, path string, content string, error int")).collect()
    assert sorted((r["file_id"], r["error"] is not None, r["error_line"]) for r in out) == [(1, True, 1), (2, False, None)]


HAND = "package com.ostmark.x;\n\n/** Adds. */\npublic class A {\n    private int n;\n\n    // Do not edit the limit without the Meter team.\n    int add(int a) {\n        return a + n;\n    }\n\n    String name() {\n        return \"n\" + n;\n    }\n}\n"


@pytest.mark.parametrize(
    ("path", "text", "why"),
    [
        ("src/A.java", HAND, []),
        ("src/A.java", "// Generated by x-gen v1. DO NOT EDIT.\n" + HAND, ["generated"]),
        ("src/A.java", "// The code generator reads this file; it is written by hand.\n" + HAND, []),
        ("src/a.g.ts", "".join(f"export const m{i} = (m: R{i}): string => {{\n  return JSON.stringify(m);\n}};\n" for i in range(5)), ["generated"]),
        ("src/a.js", "var a=1;" + "".join(f"function f{i}(a,b){{return a&&b?a+{i}:b}}" for i in range(30)), ["generated", "minified"]),
        ("src/d.js", "module.exports = {" + ",".join(f'"k{i}":"value {i}"' for i in range(80)) + "};\n", ["data"]),
        ("src/w.js", "/*\n * Copyright (c) 2012 The Quill Authors\n * SPDX-License-Identifier: MIT\n */\nfunction a(x) {\n  return x;\n}\n", ["vendored"]),
        ("vendor/quill-2.1/core/quillcore.js", "function a(x) {\n  return x;\n}\n", ["vendored"]),
        ("src/vendor/Policy.js", "function a(x) {\n  return x;\n}\n", []),
        ("src/A.java", "/* Copyright Ostmark Systems */\n" + HAND, []),
        ("src/a.js", "", []),
        ("src/b.js", "PK\x03\x04" + "\xe9\xff\x9c{};" * 80, []),
    ],
)
def test_origin(path, text, why):
    assert origin.reasons(origin.features(path, text)) == why


def test_renamed_copies(spark):
    body = "function alphaOne(items, rate) {\n  let total = 17;\n  for (const i of items) { total += i * rate; }\n  return total;\n}\nfunction betaTwo(list, cap) {\n  const top = list.filter((x) => x < cap && x > 33);\n  return top.length ? top : null;\n}\n"
    lic = "/*\n * Copyright (c) 2012 The Quill Authors\n */\n"
    own = body.replace("17", "18").replace("33", "44")
    rows = [(1, "vendor/q.js", lic + body), (2, "src/compat/x.js", body.replace("  ", "\t")), (3, "src/own.js", own), (4, "src/mine.js", "// (c) Ostmark\n" + body), (5, "src/util/quill/y.js", "let a = 1;\n"), (6, None, "x"), (7, "a.js", None)]
    got = {(r["file_id"], r["reason"]) for r in origin.origins(spark.createDataFrame(rows, "file_id long, path string, content string")).collect()}
    assert got == {(1, "vendored"), (2, "vendored"), (5, "vendored")}
    assert origin.origins(spark.createDataFrame([], "file_id long, path string, content string")).count() == 0


# ---- neighbours


def brute(rows, k, floor=None):
    ok = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    ids, x = np.array([i for i, _ in ok]), neighbours.unit(np.array([v for _, v in ok], np.float32)).astype(np.float64)
    s = x @ x.T
    out = {}
    for i in set(ids.tolist()):
        best = {}
        for a in np.flatnonzero(ids == i):
            for b in np.flatnonzero(ids != i):
                best[int(ids[b])] = max(best.get(int(ids[b]), -9), s[a, b])
        top = sorted(best.items(), key=lambda t: (-round(t[1], 5), t[0]))[:k]
        out[i] = [(j, c) for j, c in top if floor is None or c >= floor]
    return out


def test_neighbours_exact_when_small(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(150, 8)).round(3)
    rows = [(i, x[i % 140].tolist()) for i in range(150)] + [(200, None), (201, [0.0] * 8), (202, [float("nan")] * 8), (203, [1.0] * 7), (204, []), (None, x[0].tolist()), (5, x[5].tolist()), (7, x[90].tolist()), (205, [None] + [1.0] * 7), (206, [float("inf")] * 8), (207, (x[3] * 4).tolist())]
    df = spark.createDataFrame(rows, "block_id long, v array<float>")
    got = {}
    for r in neighbours.neighbours(df, "block_id", "v", 8, 5).collect():
        got.setdefault(r["block_id"], {})[r["near"]] = r["cosine"]
    want = brute(rows, 5)
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert len(got[i]) == len(w)
        assert sorted(round(c, 4) for c in got[i].values()) == pytest.approx(sorted(round(c, 4) for _, c in w), abs=2e-4)
    assert neighbours.neighbours(df.where("false"), "block_id", "v", 8, 5).count() == 0


def test_many_copies(spark):
    rows = [(i, [1.0] * 8) for i in range(400)] + [(1000 + i, np.eye(8)[i].tolist()) for i in range(8)]
    out = neighbours.neighbours(spark.createDataFrame(rows, "block_id long, v array<float>"), "block_id", "v", 8, 4)
    by = {}
    for r in out.collect():
        by.setdefault(r["block_id"], []).append(r["near"])
    assert sorted(by[0]) == [1, 2, 3, 4] and sorted(by[399]) == [0, 1, 2, 3] and all(len(v) == 4 for v in by.values())


def test_router_recall():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    x = neighbours.unit((centres[rng.integers(40, size=6000)] + 0.5 * rng.normal(size=(6000, 16))).astype(np.float32))
    router = neighbours.fit_router(x[:2500], 8)
    p = router.probs(x)
    home = p.argmax(1)
    assert np.bincount(home, minlength=8).min() > 100
    top, cnt = neighbours.probes(p, neighbours.PROBES, neighbours.MASS)
    s = x[:300] @ x.T
    s[np.arange(300), np.arange(300)] = -2
    near = np.argsort(-s, 1)[:, :10]
    hit = np.mean([home[j] in set(top[i, : cnt[i]]) for i in range(300) for j in near[i]])
    assert hit >= 0.9


def test_cells_within_cells(spark):
    """Parts of 25 rows, 8 a cell, over 3,000 rows: three levels of routers. Asking every part is exact."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    x = (centres[rng.integers(30, size=3000)] + 0.4 * rng.normal(size=(3000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "block_id long, v array<float>")
    small = {"part_rows": 25, "fan": 8, "sample": 800}
    st = neighbours.Stages(spark, "test")
    rows = df.select(F.col("block_id").alias("vid"), F.col("v").alias("u"), F.lit(0).cast("long").alias("cell"), F.explode(F.array(F.lit(0), F.lit(1))).alias("role"))
    sizes = [r["n"] for r in neighbours._cells(st, rows, 25, 8, 800, 4, 0.9).where("role = 0").groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 3000 and len(sizes) > 60 and max(sizes) <= neighbours.SPLIT * 25
    r = neighbours.recall(df, "block_id", "v", 16, 10, every=10, **small).first()
    assert r["queries"] == 300 and r["recall"] >= 0.9
    assert neighbours.recall(df, "block_id", "v", 16, 10, every=10, most=None, **small).first()["recall"] == 1.0


def test_runs_of_routed_rows():
    """A router serves the rows after it, across batches; a cell without one stays; pieces are bounded."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(9000, 8)).astype(np.float32)
    net = neighbours.Router(8, 20)
    rows = [(None, None, 3, -1, 0, pickle.dumps(net.w))] + [(i, x[i].tolist(), 3, i % 2, 0, None) for i in range(8000)] + [(i, x[i].tolist(), 4, i % 2, 0, None) for i in range(8000, 9000)]
    schema = pa.schema([("vid", pa.int64()), ("u", pa.list_(pa.float32())), ("cell", pa.int64()), ("role", pa.int32()), ("lane", pa.int64()), ("net", pa.binary())])
    whole = pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
    top, cnt = neighbours.probes(net.probs(x[:8000]), 12, 0.9)
    want = sorted([(i, 3 * (neighbours.FAN + 1) + int(p) + 1, i % 2) for i in range(8000) for p in top[i, : cnt[i] if i % 2 else 1]] + [(i, 4, i % 2) for i in range(8000, 9000)])
    for cuts in ([0, 9001], [0, 1, 5000, 8001, 9001], [0, 8500, 9001]):
        out = list(neighbours._runs((b for i, j in zip(cuts, cuts[1:], strict=False) for b in whole.slice(i, j - i).combine_chunks().to_batches()), 12, 0.9))
        assert max(len(b) for b in out) <= neighbours.PIECE
        got = pa.Table.from_batches(out)
        assert sorted(zip(*(got[c].to_pylist() for c in ("vid", "cell", "role")), strict=True)) == want
        assert all(np.array_equal(neighbours.matrix(b["u"]), x[b["vid"].to_numpy()]) for b in out)


def test_memory_does_not_follow_the_cell(spark):
    """Two cells of about 45,000 rows, routed again: a worker holds a piece of a cell at a time."""
    n, peak, done = 90_000, [0], threading.Event()
    jvm = spark.sparkContext._gateway.proc.pid

    def watch():
        while not done.wait(0.02):
            for p in psutil.Process(jvm).children(recursive=True):
                try:
                    peak[0] = max(peak[0], p.memory_full_info().uss)
                except psutil.Error:
                    pass

    rows = spark.range(n).select(F.col("id").alias("vid"), F.array(*[F.randn(i).cast("float") for i in range(16)]).alias("u"), F.lit(0).cast("long").alias("cell"), F.explode(F.array(F.lit(0), F.lit(1))).alias("role"))
    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        out = neighbours._cells(neighbours.Stages(spark, "test"), rows, 7_500, 2, 800, None, 1.0).where("role = 0").groupBy("cell").count().collect()
    finally:
        done.set()
        watcher.join()
    assert sum(r["count"] for r in out) == n and len(out) == 4
    assert 0 < peak[0] < 200e6, peak


def test_parts_are_balanced():
    rng = np.random.default_rng(3)
    x = neighbours.unit(np.r_[rng.normal(size=(900, 8)) * 0.05 + 1, rng.normal(size=(300, 8))].astype(np.float32))
    lab = neighbours.balanced_parts(x, neighbours.knn_graph(x, 8), 6)
    assert np.bincount(lab, minlength=6).max() <= np.ceil(1.1 * 1200 / 6)


def test_random_junk_never_crashes():
    rng = random.Random(6)
    alphabet = "abc {}()[]<>;:'\"`/\\*=+-.,\n#@$!?|&~0x1\x00é中"
    for _ in range(400):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        for p in ("A.java", "a.js", "a.ts", "a.tsx"):
            syntax.first_error(p, t)
            origin.reasons(origin.features(p, t))


def test_deep_nesting_is_no_error():
    """200,000 open brackets: the parser's stacks are its own, so depth is no limit and an error is still found."""
    n = 200_000
    assert syntax.first_error("a.js", "let x = " + "(" * n + "1" + ")" * n + ";") is None
    assert syntax.first_error("a.js", "let x = " + "(" * n + "1" + ")" * (n - 1) + ";") == (1, "unexpected ;")


def test_using_declarations():
    for t in ("using y = f();", "await using y = f();", "for (using x of xs) { g(x); }", "let using = 1; using = 2; using.x();"):
        assert syntax.first_error("a.ts", t) is None, t
    assert syntax.first_error("a.ts", "using y f();") is not None


ROW = "export const {0} = Object.freeze({{ id: {1}, name: \"{0}\" }});"
HAND = """import { load } from "./io";

// Loads what the caller asked for.
export function fetchAll(ids: number[]): string[] {
  const out: string[] = [];
  for (const id of ids) {
    if (id > 0) out.push(load(id));
    else { continue; }
  }

  return out;
}


export class Cache {
  private kept = new Map<number, string>();
  get(id: number) { return this.kept.get(id) }
  put(id: number, v: string) {
    this.kept.set(id, v); // last one wins
  }
}
"""


def test_layout_alone_tells_the_kinds(monkeypatch):
    """With no head, licence or folder pattern, the canonical text still tells generated, minified and data files."""
    monkeypatch.setattr(origin, "TOOL", re.compile(r"(?!)"))
    monkeypatch.setattr(origin, "TOOL_NAME", re.compile(r"(?!)"))
    kinds = lambda p, t: origin.reasons(origin.features(p, t))
    java = "package com.ostmark.a;\n\npublic class Codes {\n" + "\n".join(f"    public String get{n}() {{\n        return this.{n.lower()};\n    }}\n    public void set{n}(String v) {{\n        this.{n.lower()} = v;\n    }}" for n in ("Alpha", "Beta", "Gamma", "Delta")) + "\n}\n"
    assert kinds("src/Codes.java", java) == ["generated"]
    mini = re.sub(r"\s+", " ", re.sub(r"//[^\n]*|: (?:number\[\]|string\[\]|number|string)|private |<number, string>", "", HAND)) * 6
    assert "minified" in kinds("src/a.js", mini.replace(' import { load } from "./io";', "").replace(" = ", "=").replace("{ ", "{"))
    assert kinds("src/d.js", "module.exports = [\n" + ",\n".join(f'  "{i * 7919 % 100003:05d}abcdefgh"' for i in range(90)) + "\n];\n") == ["data"]
    assert kinds("src/cache.ts", HAND) == []


def test_canonical_text_keeps_the_tokens():
    for p, t in (("a.ts", HAND), ("B.java", "class B{int f(){return a[1]+ -b;}}")):
        kind = syntax.kind_of(p)
        toks, _, ok = origin._tokens(t, kind)
        text, gaps = origin.emit(toks)
        assert ok and [x[1] for x in origin._tokens(text, kind)[0]] == [x[1] for x in toks] and len(gaps) == len(toks)
        again = origin.layout(text, origin._tokens(text, kind)[0])
        assert again["uneven"] == 0 and again["tight"] == 0 and again["canonical"] == text
