"""Evaluation passages leaking into documents, by template canonicalisation.

Words (runs of letters and digits after NFKC and lower-casing) are replaced, each by itself, with typed placeholders:
numbers, units and names. Windows of ``WINDOW`` such template words are hashed on both sides and joined, so that
re-parameterised copies meet as well as literal ones. In each joined window the slots are compared: one value of the
item must stand for one value of the document (one to one); equal values in all slots make it literal. Windows at the same
offset between document and item are one copy, throughout which the slots must map one to one as well.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 13
BITS = 1 << 24  # of the map of item windows that is sent to the tasks; what it lets through besides, the join drops
WORD = re.compile(r"[^\W_]+")
UNITS = frozenset("mm cm m km kg g mg t lb oz v kv mv a ma w kw mw hz khz mhz ghz pa kpa mpa bar psi s ms us ns min h hr hrs k c f n nm j kj db percent volts volt watts amps seconds second minutes minute hours hour days day weeks week months month years year metres meters kelvin degrees".split())
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words(text: str | None) -> list[str]:
    """Runs of letters and digits after NFKC and lower-casing. Combining marks belong to their letter's run."""
    t = unicodedata.normalize("NFKC", text or "").lower()
    return WORD.findall(t)


def _hash(w: str) -> int:
    b = w.encode("utf-8", "surrogatepass")
    return (zlib.crc32(b) << 32) | zlib.crc32(b[::-1] + b"\x01")


def slot_type(w: str, names: frozenset[str]) -> str:
    """'' for an ordinary word, else the placeholder's type. Depends on the word alone, so that a window's template
    does not depend on where the window begins."""
    if any(c.isdigit() for c in w):
        return "#n"
    if w in UNITS:
        return "#u"
    return "#p" if w in names else ""


def _rolling(codes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of n codes."""
    if len(codes) < n:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(codes) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            h = (h ^ codes[i : len(codes) - n + 1 + i]) * _P1
            h ^= h >> np.uint64(29)
        h = h * _P2
    return h ^ (h >> np.uint64(32))


def windows(text: str | None, names: frozenset[str], n: int, memo: dict) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words, template hashes and literal hashes of all windows of a text."""
    ws = words(text)
    lit, tem = np.empty(len(ws), np.uint64), np.empty(len(ws), np.uint64)
    for i, w in enumerate(ws):
        got = memo.get(w)
        if got is None:
            s = slot_type(w, names)
            got = memo[w] = (_hash(w), _hash(s) if s else _hash(w))
            if len(memo) > 500_000:
                memo.clear()
        lit[i], tem[i] = got
    return ws, _rolling(tem, n), _rolling(lit, n)


def name_lexicon(items: DataFrame, text: str = "passage") -> frozenset[str]:
    """Words that the items only ever write with a capital inside sentences. The items are the held-out set, whose size
    is fixed; their lexicon is aggregated in Spark and bounded by them."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t in pdf[text]:
                t = unicodedata.normalize("NFKC", t or "")
                for m in WORD.finditer(t):
                    w = m.group()
                    starts = not t[: m.start()].rstrip("\"'“”«»( ") or t[: m.start()].rstrip("\"'“”«»( \n")[-1:] in ".!?:"
                    if w.isalpha() and not starts:
                        rows.append((w.lower(), int(w[0].isupper() and not (len(w) > 1 and w.isupper()))))
            yield pd.DataFrame(rows, columns=["w", "up"])

    got = items.select(text).mapInPandas(count, "w string, up int").groupBy("w").agg(F.min("up").alias("up")).where("up = 1").select("w").collect()
    return frozenset(r["w"] for r in got)


def _windowed(df: DataFrame, id_col: str, text: str, names, n: int, keep) -> DataFrame:
    """(id, pos, tem, lit, slots): every window, or only those whose template may be in the bit map ``keep``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = None if keep is None else keep.value
        lex, memo = names.value, {}
        for pdf in batches:
            cols: list[list] = [[], [], [], [], []]
            for i, t in zip(pdf[id_col], pdf[text], strict=True):
                ws, tem, lit = windows(t, lex, n, memo)
                if wanted is None:
                    at = np.arange(len(tem))
                else:
                    h = (tem & np.uint64(BITS - 1)).astype(np.int64)
                    at = np.flatnonzero(wanted[h >> 3] >> (h & 7).astype(np.uint8) & 1)
                for p in at.tolist():
                    cols[0].append(i)
                    cols[1].append(p)
                    cols[2].append(int(tem[p].view(np.int64)))
                    cols[3].append(int(lit[p].view(np.int64)))
                    cols[4].append([w for w in ws[p : p + n] if slot_type(w, lex)])
            if cols[0]:
                yield pd.DataFrame(dict(zip([id_col, "pos", "tem", "lit", "slots"], cols, strict=True)))

    return df.select(id_col, text).where(F.col(text).isNotNull()).mapInPandas(run, f"{id_col} {dict(df.dtypes)[id_col]}, pos int, tem long, lit long, slots array<string>")


def _bit_map(heads: DataFrame, c: str) -> np.ndarray:
    """A bit map of fixed size of the low bits of a column of hashes, made in Spark."""
    h, per = F.col(c).bitwiseAND(F.lit(BITS - 1)), 32_768
    out = np.zeros(BITS // 8, np.uint8)
    for r in heads.select(h.alias("h")).groupBy(F.floor(F.col("h") / per).alias("b")).agg(F.bitmap_construct_agg(F.col("h") % per).alias("m")).collect():
        bits = np.frombuffer(bytes(r["m"]), np.uint8)
        out[r["b"] * per // 8 : r["b"] * per // 8 + len(bits)] = bits
    return out


def _one_to_one(pairs: Column, left: Column, right: Column) -> Column:
    distinct = lambda c: F.size(F.array_distinct(c))
    return (distinct(pairs) == distinct(left)) & (distinct(pairs) == distinct(right))


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", doc_text: str = "text", item_text: str = "passage", window: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, n_literal, n_template): windows of an item that a document holds literally, and those it holds
    with other numbers, units or names put in consistently throughout a copy. Texts that are null, empty or shorter than a
    window match nothing; repeated rows count once."""
    spark = docs.sparkSession
    names = spark.sparkContext.broadcast(name_lexicon(items, item_text))
    it = _windowed(items.select(item_id, item_text).distinct(), item_id, item_text, names, window, None)
    it = it.select(item_id, F.col("pos").alias("i_pos"), F.col("tem").alias("i_tem"), F.col("lit").alias("i_lit"), F.col("slots").alias("i_slots"))
    keep = spark.sparkContext.broadcast(_bit_map(it, "i_tem"))
    dw = _windowed(docs.select(doc_id, doc_text), doc_id, doc_text, names, window, keep)
    j = dw.join(it, F.col("tem") == F.col("i_tem"))
    pairs = F.arrays_zip("i_slots", "slots")
    j = j.where((F.size("slots") == F.size("i_slots")) & _one_to_one(pairs, F.col("i_slots"), F.col("slots")))
    literal = (F.col("lit") == F.col("i_lit")) & (F.col("slots") == F.col("i_slots"))
    # a copy is what lies at one offset: its windows' slots, put together, must map one to one
    j = j.select(doc_id, item_id, "i_pos", (F.col("pos") - F.col("i_pos")).alias("off"), literal.alias("same"), pairs.alias("pairs"))
    g = j.groupBy(doc_id, item_id, "off").agg(F.collect_set(F.when(F.col("same"), F.col("i_pos"))).alias("lits"), F.collect_set(F.when(~F.col("same"), F.col("i_pos"))).alias("tems"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("map"))
    whole = _one_to_one(F.col("map"), F.transform("map", lambda x: x["i_slots"]), F.transform("map", lambda x: x["slots"]))
    none = F.lit(None).cast("array<int>")
    both = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c)))).cast("long")
    out = g.select(doc_id, item_id, "lits", F.when(whole, F.col("tems")).otherwise(F.coalesce(none, F.array().cast("array<int>"))).alias("tems"))
    return out.groupBy(doc_id, item_id).agg(both("lits").alias("n_literal"), both("tems").alias("n_template")).where("n_literal + n_template > 0")
