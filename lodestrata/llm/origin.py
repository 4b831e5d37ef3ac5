"""Files that nobody of the project wrote by hand: generated, minified, vendored, or data saved as code.

Every file is lexed and its tokens are emitted again in one canonical layout (:func:`emit`). The original is compared with
that text gap by gap (:func:`layout`): wrapping, spacing, indentation and blank lines.

* *minified*: the canonical text has many times the lines of the original.
* *generated*: the original deviates from the canonical text in one and the same way wherever the same kinds of tokens
  meet (``UNEVEN`` of the gaps at most do not), and its units repeat a few shapes. A tool's head says so too.
* *data*: literals dominate the code.
* *vendored*: the licence head, package or folder names somebody else than the project's owner, or most of the units are
  token for token those of such files, however they are laid out and wherever they lie.

The lexer is that of the path's extension, or else of ``language``; damaged files are cut by a loose pattern.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Stages
from . import lexing
from .syntax import kind_of

OWNER = "Ostmark"
LANGUAGES = {"java": "java", "javascript": "jsx", "js": "jsx", "typescript": "ts", "ts": "ts"}
HOLDER = re.compile(r"(?i)\b\d{4}(?:\s*-\s*\d{4})?,?\s+(?:the\s+)?([a-z][\w-]{3,})")
MARKED = re.compile(r"@(?:\w+\.)*Generated\s*(?:\(|$)", re.M)
UNEVEN = 0.004  # share of gaps that differ from their kind's usual layout, up to which a layout is uniform
TIGHT_AFTER = frozenset("( [ . ! ~ @ :: ... ?. ++ -- #".split())  # the canonical layout has no space after these
TIGHT_BEFORE = frozenset(") ] ; , . ( [ :: ++ -- : ?.".split())  # nor before these
COMMENT = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/")
EXPANSION = 4.0  # canonical lines per line of code from which a file is minified
LITERALS = 0.25  # share of literals in the code's characters from which many of them make it data
UNIT = 20  # tokens from which a unit tells where it comes from
LOOSE = re.compile(r"(?P<ws>\s+)|(?P<com>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<STR>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\[\s\S])*`)|(?P<NUM>\d[\w.]*)|(?P<ID>[^\W\d][\w$]*|\$[\w$]*)|(?P<op>=>|->|[^\w\s])")
WORDS = lexing.JAVA_RESERVED | lexing.JS_RESERVED | {"interface", "type", "let", "async", "await", "readonly"}

TOOL = re.compile(
    r"(?ix) @generated\b | \bauto[\s-]?(?:matically\s+)?generated\b(?!\s+(?:ids?|names?|keys?|values?)\b)"
    r"| \b(?:this|the)\s+(?:file|code|class|source|module)\s+(?:is|was|has\s+been)\s+(?:\w+\s+){0,2}(?:generated|created\s+by\s+a|machine[\s-]?made|produced\s+by)"
    r"| \bmachine[\s-](?:made|generated|written)\b | ^\W*(?:code\s+)?generated\s+(?:by|from|with|using|on|at)\b | \bgenerated\s+(?:by|from|with|using)\s+(?:the\s+)?[\w./@+-]+(?:\s+\S+){0,4}\s*[.;,]\s*(?:please\s+)?do\s+not\s+(?:edit|modify|change)"
    r"| \b(?:automatisch|maschinell)\s+(?:erzeugt|generiert|erstellt) | \bg[ée]n[ée]r[ée]\s+automatiquement | \bgenerado\s+autom[áa]ticamente | \bавтоматически\s+(?:создан|сгенерирован)"
    r"| \b(?:code|file|source)\s+(?:produced|emitted|generated|created|written)\s+by\s+(?!hand\b)\w+"
    r"| ^\W*(?:created|emitted|written|produced|built)\s+by\s+(?:the\s+|a\s+)?[\w .@/+-]*?(?:writer|generator|compiler|codegen|builder|tool|weaver|scaffolder)\b"
    r"| \b(?:manual|hand|your|local|any)\s+(?:edits?|changes?|modifications?)\s+(?:\w+\s+){0,3}(?:overwritten|lost|discarded)\b | \bchanges\s+will\s+be\s+(?:lost|overwritten)\b | \bregenerate\s+(?:with|by|using|via)\b"
    r"| ^\W*(?:please\s+)?do\s+not\s+(?:edit|modify|change|touch)(?:\s+(?:this\s+file|by\s+hand|manually|directly))?\s*[.!*/\s]*$",
    re.M,
)
BY_HAND = re.compile(r"(?i)\b(?:written|maintained|edited)\s+by\s+hand\b|\bnot\s+(?:auto-?)?generated\b|\bhand-?written\b")
LICENCE = re.compile(r"(?im)^[\s/*#!]*(?:copyright\b|\(c\)|©|SPDX-License-Identifier:|licen[sc]ed\s+under|@license\b|@copyright\b)[^\n]*")
LIB_DIR = re.compile(r"(?:^|/)(?:vendor|vendors|third[_-]?party|thirdparty|external|externals|deps|libs|lib|node_modules|bower_components|extern|contrib)/([^/]+)/")
MINI_NAME = re.compile(r"[.-]min\.\w+$", re.I)
TOOL_NAME = re.compile(r"(?:\.(?:generated|gen|g|pb|designer)\.\w+|_pb2?\.\w+|_generated\.\w+)$", re.I)


def _tokens(src: str, kind: str | None):
    """(type, text, start, end) of all tokens, and comment spans; by a loose pattern where the file is damaged."""
    if kind:
        try:
            t = lexing.lex(src, kind)
            return list(zip(t[:-1], t.text, t.at, t.to, strict=False)), t.comments, True
        except lexing.LexError:
            pass
    toks, com, at = [], [], 0
    while at < len(src):
        m = LOOSE.match(src, at)
        if m is None:
            at += 1
            continue
        g = m.lastgroup
        if g == "com":
            com.append((at, m.end()))
        elif g != "ws":
            w = m.group()
            toks.append((w if g == "op" or (g == "ID" and w in WORDS) else g, w, at, m.end()))
        at = m.end()
    return toks, com, False


def canonical_lines(toks) -> list[tuple[int, int]]:
    """Token ranges of the lines of the canonical layout: a line ends after ``;``, ``{`` and ``}``, but not in brackets."""
    out, a, depth = [], 0, 0
    for i, (k, *_) in enumerate(toks):
        if k in ("(", "["):
            depth += 1
        elif k in (")", "]"):
            depth = max(0, depth - 1)
        if k in (";", "}") and depth == 0 or k == "{" or k == "}":
            nxt = toks[i + 1][0] if i + 1 < len(toks) else ""
            if k == "}" and nxt in (";", ",", ")", "else", "catch", "finally", "while"):
                continue
            out.append((a, i + 1))
            a = i + 1
    if a < len(toks):
        out.append((a, len(toks)))
    return out


def emit(toks) -> tuple[str, list[str]]:
    """The tokens in canonical layout: one statement or brace a line, four spaces a level, one space between words and
    operators; and the white space before each token."""
    starts = {a for a, _ in canonical_lines(toks)}
    gaps, depth = [], 0
    for i, (k, *_) in enumerate(toks):
        if k == "}":
            depth = max(0, depth - 1)
        if i == 0:
            gaps.append("")
        elif i in starts:
            gaps.append("\n" + "    " * depth)
        else:
            gaps.append("" if toks[i - 1][0] in TIGHT_AFTER or k in TIGHT_BEFORE else " ")
        if k == "{":
            depth += 1
    return "".join(g + t[1] for g, t in zip(gaps, toks, strict=True)), gaps


def layout(src: str, toks) -> dict:
    """How the original differs from the canonical text.

    ``uneven``: share of gaps whose deviation (joined, spaced, wrapped, blank lines, indent) is not the usual one between
    such tokens. ``blanks``: different numbers of blank lines between canonical lines. ``tight``: share of canonical
    spaces that the original leaves out. ``expansion``: canonical lines per line of code.
    """
    text, gaps = emit(toks)
    seen: dict = {}
    indents: dict = {}
    blanks, missing, spaces, lines = set(), 0, 0, set()
    kind = lambda k: k if not k.isalnum() or k in WORDS else "w" if k == "ID" else "l"
    line = src.count("\n", 0, toks[0][2]) if toks else 0
    lines.add(line)
    for i in range(1, len(toks)):
        raw = src[toks[i - 1][3] : toks[i][2]]
        line += src.count("\n", toks[i - 1][2], toks[i][2])
        lines.add(line)
        gap = COMMENT.sub("", raw) if "/" in raw else raw
        n, want = gap.count("\n"), gaps[i]
        wrapped = want[:1] == "\n"
        deviation = ("n", min(n, 3)) if n else ("s", 0) if gap else ("", 0)
        ctx = seen.setdefault((kind(toks[i - 1][0]), kind(toks[i][0]), wrapped), {})
        ctx[deviation] = ctx.get(deviation, 0) + 1
        if wrapped and n:
            width = len(gap[gap.rindex("\n") + 1 :].expandtabs(4))
            d = indents.setdefault(len(want), {})
            d[width] = d.get(width, 0) + 1
            blanks.add(n - 1)
        elif want == " ":
            spaces += 1
            missing += not gap
    groups = [*seen.values(), *indents.values()]
    total = sum(sum(g.values()) for g in groups)
    uneven = sum(sum(g.values()) - max(g.values()) for g in groups)
    return {"uneven": uneven / max(1, len(toks) - 1) if total else 1.0, "blanks": len(blanks), "tight": missing / max(1, spaces), "expansion": (text.count("\n") + 1) / max(1, len(lines)), "canonical": text}


def units(toks) -> list[tuple[int, int]]:
    """Token ranges of the members of a file: top-level statements, and the members of types and modules in them."""
    out, a, depth, round_ = [], 0, 0, 0
    open_type: list[bool] = []
    for i, (k, *_) in enumerate(toks):
        if k in ("(", "["):
            round_ += 1
        elif k in (")", "]"):
            round_ = max(0, round_ - 1)
        elif k == "{":
            head = {t[0] for t in toks[a:i]} | {t[1] for t in toks[a : min(i, a + 8)]}
            is_type = round_ == 0 and all(open_type) and bool(head & {"class", "interface", "enum", "namespace", "record", "module"}) and "=" not in head
            open_type.append(is_type)
            if is_type:
                out.append((a, i + 1))
                a = i + 1
        elif k == "}":
            was = open_type.pop() if open_type else True
            if was:
                if a < i:
                    out.append((a, i))
                a = i + 1
            elif all(open_type) and round_ == 0 and (i + 1 >= len(toks) or toks[i + 1][0] not in (";", ",", ")", ".", "(", "else", "catch", "finally", "as")):
                out.append((a, i + 1))
                a = i + 1
        elif k == ";" and round_ == 0 and all(open_type):
            if i + 1 - a > 1:
                out.append((a, i + 1))
            a = i + 1
    if a < len(toks):
        out.append((a, len(toks)))
    return out


def features(path: str, content: str, owner: str = OWNER, language: str | None = None) -> dict:
    """What the layout, the literals, the head and the path of one file say."""
    src = content.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    toks, com, _parsed = _tokens(src, kind_of(path) or LANGUAGES.get((language or "").strip().lower()))
    code = sum(t[3] - t[2] for t in toks)
    lit = sum(t[3] - t[2] for t in toks if t[0] in ("STR", "NUM", "CHAR", "TEMPLATE", "TEXT"))
    n_lit = sum(t[0] in ("STR", "NUM", "CHAR", "TEMPLATE") for t in toks)
    longest = max((t[3] - t[2] for t in toks if t[0] in ("STR", "TEMPLATE")), default=0)
    look = layout(src, toks)
    names = [t[1] for t in toks if t[0] == "ID"]
    short = sum(len(x) <= 2 for x in names) / max(1, len(names))
    us = units(toks)
    seq, size, bodies = [], 0, 0
    for a, b in us:
        ks = [t[0] for t in toks[a:b]]
        if b - a > 3 and ks[0] not in ("import", "package") and not (ks[-1] == "{" and b - a < 24) and not _requires(toks[a:b]):
            seq.append(" ".join("LIT" if k in ("true", "false", "null", "STR", "NUM") else k for k in ks))
            size += b - a
            bodies += "{" in ks or "=" in ks
    period, cycles = _period(seq)
    # what stands between units: blank lines and comments after the first unit
    body = [u for u in us if toks[u[0]][0] not in ("import", "package")]
    start = toks[body[0][0]][2] if body else len(src)
    inner_com = sum(a > start for a, _ in com)
    blank = len(re.findall(r"\n[ \t]*\n(?=[ \t]*\S)", src[start:].rstrip()))
    own = owner.lower()
    heads = "\n".join(src[a:b] for a, b in com if a <= start)
    lic = [m.group(0) for m in LICENCE.finditer(heads)]
    has_own = own in heads.lower()
    pkg = re.search(r"(?m)^\s*package\s+([\w.]+)\s*;", src)
    lib = LIB_DIR.search("/" + path.replace("\\", "/"))
    name = re.sub(r"[-_.]?v?\d[\w.]*$", "", lib.group(1)).lower() if lib else ""
    file = path.replace("\\", "/").rsplit("/", 1)[-1].lower()
    lib_dir = bool(lib) and len(name) > 2 and (name in file or name != lib.group(1).lower())
    marks = [zlib.crc32(" ".join(t[1] for t in toks[a:b]).encode("utf-8", "surrogatepass")) for a, b in us if b - a >= UNIT and toks[a][0] not in ("import", "package")]
    grams = [(x << 31) ^ y for x, y in zip(marks, marks[1:], strict=False)] or ([zlib.crc32(" ".join(t[1] for t in toks).encode("utf-8", "surrogatepass")) << 31 | 1] if len(toks) >= UNIT else [])
    odd = sum(not (c.isprintable() or c in "\n\t\x0c") or "\x80" <= c <= "\xff" for c in src) / max(1, len(src))
    return {
        "tokens": len(toks), "expansion": look["expansion"], "uneven": look["uneven"], "blanks": look["blanks"], "tight": look["tight"], "literal": lit / max(1, code), "n_lit": n_lit, "longest": longest, "short": short,
        "period": period, "cycles": cycles, "unit_size": size / max(1, len(seq)), "bodies": bodies / max(1, len(seq)), "inner_com": inner_com, "blank": blank, "odd": odd, "parsed": _parsed,
        "tool": (bool(TOOL.search(heads)) and not BY_HAND.search(heads)) or bool(MARKED.search(src[: toks[body[0][1] - 1][3]] if body else "")),
        "foreign": bool(lic) and not has_own, "own": has_own, "package": bool(pkg) and "." in pkg.group(1) and own not in pkg.group(1).lower(), "lib": lib_dir, "named": bool(TOOL_NAME.search(path)), "grams": grams,
        "names": sorted({n.lower() for x in lic if own not in x.lower() for n in HOLDER.findall(x)} | ({pkg.group(1).lower().split(".")[1]} if pkg and pkg.group(1).count(".") and own not in pkg.group(1).lower() else set())),
        "parts": sorted({re.sub(r"[-_.]?v?\d[\w.]*$", "", d).lower() for d in path.replace("\\", "/").split("/")[:-1]} - {""}),
    }


def _requires(toks) -> bool:
    """An import by require, or an export list: the frame of a script, not its substance."""
    return len(toks) < UNIT and any(t[1] in ("require", "exports") for t in toks[:6])


def _period(seq: list[str]) -> tuple[int, float]:
    """The shortest cycle of shapes that the units repeat, and how often; a unit or two before and after may differ."""
    best = (0, 0.0)
    n = len(seq)
    for p in range(1, min(8, n // 2) + 1):
        longest = run = 0
        for i in range(p, n):
            run = run + 1 if seq[i] == seq[i - p] else 0
            longest = max(longest, run)
        if longest and longest + p >= 0.8 * n and longest + p >= n - 3:
            return p, (longest + p) / p
    return best


def reasons(x: dict) -> list[str]:
    """Why a file is not hand-written, from its own features: generated, minified, vendored, data."""
    out = []
    if x["odd"] > 0.1 and not x["tool"]:
        return out  # bytes of another format
    bare = x["blank"] == 0 and x["inner_com"] == 0
    # perfect uniformity: of the layout throughout, and of the units' shapes; blank lines that vary need more repetition
    even = x["uneven"] <= UNEVEN and x["cycles"] >= 2 and x["blanks"] <= 1 and x["unit_size"] >= 7
    even = even or (x["uneven"] <= 5 * UNEVEN and x["cycles"] >= 3 and (x["bodies"] >= 0.9 and x["unit_size"] >= 10 and bare if x["period"] == 1 else x["unit_size"] >= 7))
    if x["tool"] or even or (x["named"] and x["cycles"] >= 2):
        out.append("generated")
    if x["expansion"] >= EXPANSION and x["tokens"] >= 100:
        out.append("minified")
    if x["foreign"] or x["package"] or x["lib"]:
        out.append("vendored")
    if x["literal"] >= LITERALS and (x["n_lit"] >= 40 or x["longest"] >= 400 or (x["longest"] >= 200 and x["literal"] >= 2 * LITERALS)):
        out.append("data")
    return out


def origins(files: DataFrame, id_col: str = "file_id", owner: str = OWNER) -> DataFrame:
    """(id, reason), one row per reason a file is not hand-written; none for hand-written files.

    Null content or path tells nothing; a file's repeated rows count once; empty files are hand-written.
    """
    spark = files.sparkSession
    st = Stages(spark, "origins")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, p, c, lang in zip(pdf["id"], pdf["path"], pdf["content"], pdf["language"], strict=True):
                x = features(p, c, owner, lang)
                rows.append((i, reasons(x), sorted(set(x["grams"])), x["own"], x["names"], x["parts"]))
            yield pd.DataFrame(rows, columns=["id", "reasons", "grams", "own", "names", "parts"])

    lang = F.col("language") if "language" in files.columns else F.lit(None).cast("string")
    f = files.select(F.col(id_col).alias("id"), "path", "content", lang.alias("language")).where("path is not null and content is not null")
    f = f.groupBy("id", "path", "content").agg(F.min("language").alias("language"))
    x = st.put(f.mapInPandas(run, f"id {dict(files.dtypes)[id_col]}, reasons array<string>, grams array<bigint>, own boolean, names array<string>, parts array<string>"))
    known = x.where(F.array_contains("reasons", "vendored")).select(F.explode("grams").alias("g")).distinct()
    rest = x.where(~F.array_contains("reasons", "vendored") & ~F.col("own")).select("id", F.explode("grams").alias("gram"), F.size("grams").alias("n"))
    copies = rest.join(known, F.col("gram") == F.col("g"), "left_semi").groupBy("id").agg(F.count_distinct("gram").alias("hit"), F.max("n").alias("n")).where("hit * 2 > n").select("id", F.lit("vendored").alias("reason"))
    # folders that bear the name of somebody who holds the rights elsewhere, and that no file of the owner lies in
    ours = x.where("own").select(F.explode("parts").alias("o")).distinct()
    holders = x.where(F.size("names") > 0).select(F.explode("names").alias("h")).distinct().join(ours, F.col("h") == F.col("o"), "left_anti")
    under = x.where(~F.array_contains("reasons", "vendored") & ~F.col("own")).select("id", F.explode("parts").alias("part"))
    named = under.join(holders, F.col("part") == F.col("h"), "left_semi").select("id", F.lit("vendored").alias("reason")).distinct()
    return x.select("id", F.explode("reasons").alias("reason")).unionByName(copies).unionByName(named).distinct().withColumnRenamed("id", id_col)
