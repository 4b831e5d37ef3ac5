"""Source files that do not parse, by table-driven parsers of bundled grammars.

The language is the one that the path's extension stands for. The whole content is lexed and parsed; the first error
that no derivation gets past is reported with its line. A byte-order mark, CRLF, ``import`` in ``.js`` and empty files
are no errors. Null content is not judged; paths without a known extension are left out. What only a later check of the
language would reject (two declarations of a name, ``return`` or ``break`` outside of a function or loop) counts as valid.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import grammars, lexing


def kind_of(path: str | None) -> str | None:
    ext = (path or "").rsplit("/", 1)[-1].rpartition(".")
    return lexing.EXTENSIONS.get(ext[2].lower()) if ext[1] else None


def first_error(path: str | None, content: str | None) -> tuple[int, str] | None:
    """(line from 1, message) of the first unrecoverable error, or None."""
    kind = kind_of(path)
    if kind is None or content is None:
        return None
    src = content.removeprefix("﻿")
    if not src.strip():
        return None
    if "\r" in src:
        src = src.replace("\r\n", "\n").replace("\r", "\n")
    try:
        tokens = lexing.lex(src, kind)
    except lexing.LexError as e:
        return src.count("\n", 0, e.pos) + 1, str(e)
    at = grammars.parser(kind).parse(tokens)
    bad = (at, f"unexpected {tokens.text[at][:40] or 'end of file'}") if at >= 0 else _tags(tokens)
    if bad is None:
        return None
    return src.count("\n", 0, tokens.at[bad[0]]) + 1, bad[1]


def _tags(tokens) -> tuple[int, str] | None:
    """A closing tag whose name differs from its opening one."""
    if "JSXOPEN" not in tokens:
        return None
    open_: list[str] = []
    i, n = 0, len(tokens)
    while i < n:
        t = tokens[i]
        if t in ("JSXOPEN", "JSXCLOSE"):
            j = i + 1
            while tokens[j] in ("JSXNAME", ":", ".") and (tokens[j] != "JSXNAME" or j == i + 1 or tokens[j - 1] in (":", ".")):
                j += 1
            name = "".join(tokens.text[i + 1 : j])
            if t == "JSXOPEN":
                open_.append(name)
            elif not open_ or open_.pop() != name:
                return i, f"closing tag {name[:40]} does not match"
            i = j
            continue
        if t == "JSXSELF" and open_:
            open_.pop()
        i += 1
    return None


def syntax_errors(files: DataFrame, id_col: str = "file_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, error_line, error) for every file; both are null where the content parses. Repeated rows count once."""
    cols = [id_col, *keep]
    out = ", ".join(f"{c} {dict(files.dtypes)[c]}" for c in cols) + ", error_line int, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [first_error(p, c) or (None, None) for p, c in zip(pdf["_path"], pdf["_content"], strict=True)]
            res = pdf[cols].copy()
            res["error_line"] = pd.array([g[0] for g in got], dtype="Int32")
            res["error"] = [g[1] for g in got]
            yield res

    f = files.where(F.col("content").isNotNull() & known("path")).select(*cols, F.col("path").alias("_path"), F.col("content").alias("_content")).distinct()
    return f.mapInPandas(run, out)


def known(path: str) -> Column:
    return F.lower(F.substring_index(F.col(path), ".", -1)).isin(list(lexing.EXTENSIONS))
