"""Lexers for Java, JavaScript and TypeScript (with JSX), driven by one pattern per mode.

A token has a type: reserved words, contextual words and punctuation are their own type; the others are ID, NUM, STR,
CHAR, REGEX, TEMPLATE (whole, or the parts THEAD, TMID, TTAIL), PRIV (#name), TEXT (between JSX tags), and JSX tag marks.
``>`` is always one token (``>~`` when another ``>`` or ``=`` follows at once), so that nested type arguments close.
"""

from __future__ import annotations

import re

EXTENSIONS = {"java": "java", "js": "jsx", "jsx": "jsx", "mjs": "jsx", "cjs": "jsx", "ts": "ts", "mts": "ts", "cts": "ts", "tsx": "tsx"}

JAVA_RESERVED = frozenset("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null _".split())
JAVA_CONTEXT = frozenset("var record sealed permits non yield when module open exports opens requires uses provides to with".split())
JS_RESERVED = frozenset("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum".split())
JS_CONTEXT = frozenset("let static async await yield of get set as from accessor using".split())
TS_CONTEXT = JS_CONTEXT | frozenset("type interface namespace module declare abstract readonly public private protected override implements keyof unique infer is asserts global satisfies out require any unknown never object string number boolean symbol bigint undefined".split())


class LexError(Exception):
    def __init__(self, pos: int, why: str):
        super().__init__(why)
        self.pos = pos


class Tokens(list):
    """Token types; with ``text``, ``at`` (start), ``to`` (end), ``nl`` (a line end stands before), ``comments``."""

    def __init__(self):
        super().__init__()
        self.text: list[str] = []
        self.at: list[int] = []
        self.to: list[int] = []
        self.nl: list[bool] = []
        self.comments: list[tuple[int, int]] = []
        self.far = 0


JAVA = re.compile(
    r"""(?P<ws>[ \t\f\r\x0b\x1a﻿]+|\n)
    |(?P<com>//[^\n]*|/\*[\s\S]*?\*/)
    |(?P<text>\"\"\"[ \t\f]*\r?\n(?:[^\\"]|\\[\s\S]|"(?!""))*\"\"\")
    |(?P<str>"(?:[^"\\\n\r]|\\u+[0-9a-fA-F]{4}|\\[btnfrs"'\\0-7])*")
    |(?P<char>'(?:[^'\\\n\r]|\\u+[0-9a-fA-F]{4}|\\[btnfrs"'\\]|\\[0-3]?[0-7]{1,2})(?:[\udc00-\udfff])?')
    |(?P<num>(?:0[xX][0-9a-fA-F_]*(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?[0-9_]+)?|0[bB][01_]+|(?:[0-9][0-9_]*\.?(?:[0-9][0-9_]*)?|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?)[lLfFdD]?(?![\w$]))
    |(?P<id>[^\W\d][\w$]*|\$[\w$]*)
    |(?P<op>\.\.\.|->|::|\+\+|--|&&|\|\||<<=|<<|[=!<+\-*/&|^%]=|>|[@(){}\[\];,.=<!~?:+\-*/&|^%])""",
    re.X,
)
_JS = r"""(?P<ws>[ \t\f\r\x0b\xa0﻿   - 　]+|\n)
    |(?P<com>//[^\n]*|/\*[\s\S]*?\*/)
    |(?P<str>"(?:[^"\\\n\r]|\\\r\n|\\[\s\S])*"|'(?:[^'\\\n\r]|\\\r\n|\\[\s\S])*')
    |(?P<num>(?:0[xX][0-9a-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:[0-9][0-9_]*n|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?))(?![\w$]))
    |(?P<id>(?:[^\W\d]|[$℘]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$‌‍]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*)
    |(?P<priv>\#(?:[^\W\d]|\$)[\w$]*)
    |(?P<op>\.\.\.|=>|\+\+|--|\*\*=|\*\*|&&=|\|\|=|\?\?=|&&|\|\||\?\?|\?\.(?![0-9])|===|!==|==|!=|<<=|<<|<=|[+\-*/%&|^]=|>|[@(){}\[\];,.=<!~?:+\-*/&|^%])"""
JS = re.compile(_JS, re.X)
REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*(?![\w$])")
TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)")
JSX_NAME = re.compile(r"[^\W\d][\w$]*(?:-[\w$]*)*|\$[\w$-]*")
JSX_STR = re.compile(r"\"[^\"]*\"|'[^']*'")
JSX_TEXT = re.compile(r"[^{}<>]+")
GENERIC_ARROW = re.compile(r"<\s*(?:const\s+)?[\w$]+\s*(?:,|extends\b|=)")
# after these an operand has ended, so that / divides and < compares
OPERAND_END = frozenset(["ID", "NUM", "STR", "REGEX", "TEMPLATE", "TTAIL", "PRIV", ")", "]", "}", "this", "super", "null", "true", "false", "++", "--", "JSXEND"])


def lex(src: str, kind: str, jsx: bool = True) -> Tokens:
    return _java(src) if kind == "java" else _script(src, kind)


def _java(src: str) -> Tokens:
    out, pos, n, nl = Tokens(), 0, len(src), False
    match = JAVA.match
    while pos < n:
        m = match(src, pos)
        if m is None:
            raise LexError(pos, "unexpected character")
        g, end = m.lastgroup, m.end()
        if g == "ws":
            if src[pos] == "\n":
                nl = True
        elif g == "com":
            out.comments.append((pos, end))
            nl = nl or "\n" in m.group()
        else:
            t = m.group()
            if g == "id":
                k = t if t in JAVA_RESERVED or t in JAVA_CONTEXT else "ID"
            elif g == "op":
                k = ">~" if t == ">" and src[end : end + 1] in ">=" and src[end : end + 1] else t
            else:
                k = "NUM" if g == "num" else "CHAR" if g == "char" else "STR"
            out.append(k)
            out.text.append(t)
            out.at.append(pos)
            out.to.append(end)
            out.nl.append(nl)
            nl = False
        pos = end
    return _end(out, n, nl)


def _end(out: Tokens, n: int, nl: bool) -> Tokens:
    out.append("EOF")
    out.text.append("")
    out.at.append(n)
    out.to.append(n)
    out.nl.append(True)
    return out


def _script(src: str, kind: str) -> Tokens:
    words = JS_RESERVED | (TS_CONTEXT if kind in ("ts", "tsx") else JS_CONTEXT)
    operand = OPERAND_END | (words - JS_RESERVED)
    has_jsx = kind in ("jsx", "tsx")
    out, pos, n, nl = Tokens(), 0, len(src), False
    if src.startswith(("#!", "﻿#!")):
        pos = src.find("\n") if "\n" in src else n
    stack: list[str] = []  # open tag, kids (between tags), jsx (braces in either), tmpl, block and js braces
    parens: list[bool] = []
    closing = False  # the open tag is a closing one
    head_end = False
    block_end = False
    match = JS.match

    def put(k: str, a: int, b: int) -> None:
        nonlocal nl
        out.append(k)
        out.text.append(src[a:b])
        out.at.append(a)
        out.to.append(b)
        out.nl.append(nl)
        nl = False

    def template(a: int, first: bool) -> int:
        m = TEMPLATE.match(src, a + 1)
        if m is None:
            raise LexError(a, "template does not end")
        done = m.group(1) == "`"
        put(("TEMPLATE" if done else "THEAD") if first else ("TTAIL" if done else "TMID"), a, m.end())
        if not done:
            stack.append("tmpl")
        return m.end()

    while pos < n:
        top = stack[-1] if stack else ""
        if top == "tag":
            c = src[pos]
            if c.isspace():
                nl = nl or c == "\n"
                pos += 1
            elif src.startswith(("//", "/*"), pos) and not src.startswith("/>", pos):
                m = match(src, pos)
                if m is None or m.lastgroup != "com":
                    raise LexError(pos, "comment does not end")
                out.comments.append((pos, m.end()))
                pos = m.end()
            elif src.startswith("/>", pos):
                stack.pop()
                put("JSXSELF", pos, pos + 2)
                pos += 2
            elif c == ">":
                if closing:
                    closing = False
                    stack.pop()
                    put("JSXEND", pos, pos + 1)
                else:
                    stack[-1] = "kids"
                    put("JSXGT", pos, pos + 1)
                pos += 1
            elif c == "{":
                stack.append("jsx")
                put("{", pos, pos + 1)
                pos += 1
            elif c in "\"'":
                m = JSX_STR.match(src, pos)
                if m is None:
                    raise LexError(pos, "string does not end")
                put("STR", pos, m.end())
                pos = m.end()
            elif c in "=:.":
                put(c, pos, pos + 1)
                pos += 1
            elif c == "<" and kind == "tsx":
                raise LexError(pos, "type arguments in a tag")
            else:
                m = JSX_NAME.match(src, pos)
                if m is None:
                    raise LexError(pos, "unexpected character in a tag")
                put("JSXNAME", pos, m.end())
                pos = m.end()
            continue
        if top == "kids":
            m = JSX_TEXT.match(src, pos)
            if m:
                if m.group().strip():
                    put("TEXT", pos, m.end())
                pos = m.end()
                continue
            c = src[pos]
            if c == "{":
                stack.append("jsx")
                put("{", pos, pos + 1)
                pos += 1
                continue
            if src.startswith("</", pos):
                put("JSXCLOSE", pos, pos + 2)
                stack[-1] = "tag"
                closing = True
                pos += 2
                continue
            if c == "<":
                put("JSXOPEN", pos, pos + 1)
                stack.append("tag")
                pos += 1
                continue
            raise LexError(pos, "unexpected character between tags")
        c = src[pos]
        if c == "`":
            pos = template(pos, True)
            continue
        prev = out[-1] if out else ""
        after_operand = prev in operand and not (prev == ")" and head_end) and not (prev == "}" and block_end) or prev in ("JSXSELF", "JSXEND")
        if c == "/" and not after_operand and not src.startswith(("//", "/*"), pos):
            m = REGEX.match(src, pos)
            if m is None:
                raise LexError(pos, "expression does not end")
            put("REGEX", pos, m.end())
            pos = m.end()
            continue
        if c == "<" and has_jsx and not after_operand:
            nx = src[pos + 1 : pos + 2]
            if (nx.isalpha() or nx in ("_", "$", ">")) and nx and not (kind == "tsx" and GENERIC_ARROW.match(src, pos)):
                put("JSXOPEN", pos, pos + 1)
                stack.append("tag")
                pos += 1
                continue
        if c == "}" and top == "tmpl":
            stack.pop()
            pos = template(pos, False)
            continue
        m = match(src, pos)
        if m is None:
            raise LexError(pos, "unexpected character")
        g, end = m.lastgroup, m.end()
        if g == "ws":
            if "\n" in m.group() or " " in m.group():
                nl = True
            pos = end
            continue
        if g == "com":
            out.comments.append((pos, end))
            nl = nl or "\n" in m.group()
            pos = end
            continue
        t = m.group()
        if g == "id":
            k = t if t in words and prev not in (".", "?.") else "ID"
            if k != "ID" and k in JS_RESERVED and src[end : end + 1] == ":" and prev in ("{", ","):
                k = t
        elif g == "op":
            k = ">~" if t == ">" and src[end : end + 1] in (">", "=") else t
            if t == "{":
                block = prev in ("", ")", ";", "{", "}", "=>", "else", "do", "try", "finally", ":")
                stack.append("block" if block else "js")
            elif t == "}":
                kind_of = stack.pop() if stack else "js"
                block_end = kind_of == "block" and prev != "=>"
            elif t == "(":
                parens.append(prev in ("if", "while", "for", "with"))
            elif t == ")":
                head_end = parens.pop() if parens else False
        else:
            k = {"num": "NUM", "str": "STR", "priv": "PRIV"}[g]
        put(k, pos, end)
        pos = end
    if any(x in ("tag", "kids", "jsx", "tmpl") for x in stack):
        raise LexError(n, "file ends inside a tag or template")
    return _end(out, n, nl)
