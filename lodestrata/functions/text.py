"""Analyzers and small text functions. All but the stemmer are built-in expressions, evaluated in the JVM."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def simple_terms(c: Column | str) -> Column:
    """Lower-cased ASCII letter and digit runs, in order, with repeats. Null gives an empty array."""
    c = F.col(c) if isinstance(c, str) else c
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda x: x != "")


def trigrams(c: Column | str) -> Column:
    """Distinct lower-cased character trigrams; shorter texts have none."""
    c = F.lower(F.col(c) if isinstance(c, str) else c)
    n = F.length(c)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substr(c, i, F.lit(3))))).otherwise(F.expr("cast(array() as array<string>)"))


_V = "[aeiouy]"


def _measure(w: str) -> int:
    """The number of vowel-consonant sequences, y counting as a vowel after a consonant."""
    s = ""
    for i, c in enumerate(w):
        s += "v" if c in "aeiou" or (c == "y" and i and s[-1] == "c") else "c"
    return len(re.findall("v+c+", s))


def _vowel(w: str) -> bool:
    return any(c in "aeiou" or (c == "y" and i and w[i - 1] not in "aeiou") for i, c in enumerate(w))


def _cvc(w: str) -> bool:
    if len(w) < 3 or w[-1] in "wxy":
        return False
    is_v = lambda i: w[i] in "aeiou" or (w[i] == "y" and i > 0 and not is_v(i - 1))
    return not is_v(len(w) - 1) and is_v(len(w) - 2) and not is_v(len(w) - 3)


# fixed values: the suffix steps of the published algorithm
STEP2 = "ational ate,tional tion,enci ence,anci ance,izer ize,abli able,alli al,entli ent,eli e,ousli ous,ization ize,ation ate,ator ate,alism al,iveness ive,fulness ful,ousness ous,aliti al,iviti ive,biliti ble"
STEP3 = "icate ic,ative ,alize al,iciti ic,ical ic,ful ,ness "
STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize"
_S2 = [tuple((x + " ").split(" ")[:2]) for x in STEP2.split(",")]
_S3 = [tuple((x + " ").split(" ")[:2]) for x in STEP3.split(",")]


def porter(w: str) -> str:
    """The stem of a lower-case English word (M. F. Porter, 1980)."""
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix):
                if _vowel(w[: -len(suffix)]):
                    w = w[: -len(suffix)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulsz":
                        w = w[:-1]
                    elif _measure(w) == 1 and _cvc(w):
                        w += "e"
                break
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_S2, _S3):
        for a, b in sorted(table, key=lambda x: -len(x[0])):
            if w.endswith(a):
                if _measure(w[: -len(a)]) > 0:
                    w = w[: -len(a)] + b
                break
    for a in sorted([*STEP4.split(), "sion", "tion"], key=len, reverse=True):
        if w.endswith(a):
            cut = w[:-3] if a in ("sion", "tion") else w[: -len(a)]
            if _measure(cut) > 1:
                w = cut
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def porter_terms(text: str | None, memo: dict | None = None) -> list[str]:
    """Letter and digit runs, diacritics removed, lower-cased and stemmed."""
    t = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c)).lower()
    memo = {} if memo is None else memo
    out = []
    for w in re.findall(r"[^\W_]+", t):
        s = memo.get(w)
        if s is None:
            s = memo[w] = porter(w) if w.isascii() and w.isalpha() else w
        out.append(s)
    return out


def stemmed(c: Column) -> Column:
    """:func:`porter_terms` over Arrow batches."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        memo: dict = {}
        return texts.map(lambda t: porter_terms(t, memo))

    return run(c)


def natural_key(c: Column | str) -> Column:
    """A sort key in which digit runs compare as numbers: every run is padded to 20 digits."""
    c = F.upper(F.col(c) if isinstance(c, str) else c)
    marked = F.regexp_replace(c, r"(\d+)", "\u0001" + "0" * 20 + "$1\u0002")
    return F.regexp_replace(marked, "\u0001" + r"0*(\d{20})" + "\u0002", "$1")
