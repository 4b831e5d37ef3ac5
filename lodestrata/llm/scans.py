"""Noise in text read from scanned pages: furniture, broken, misread and run-together words, and split paragraphs.

1. *Furniture.* From a block's first and last line inwards, a line is furniture if it consists of page numbers, dates and
   the document's own title and designation, or if the same line (misreadings folded together) recurs on ``PAGES`` pages
   and a third of the document's pages.
2. *Vectors.* Skip-gram vectors with negative sampling are learned from all remaining text. They live in a hashed table
   whose size follows the number of frequent words (``slots_for``); partitions train copies, which are averaged slot by
   slot with the slot's words as weights, in a tree of ``FAN`` copies a task.
3. *Linking.* The vector of a rare word is the mean of its contexts. Its neighbours are the frequent words that are closer
   to it than frequent words are on average (``closeness`` above 0, in standard deviations). A rare word is linked to the
   neighbours that one or two plausible glyph edits, a healed line end or a split make of it. Both conditions must hold;
   the glyph edits are looked up first because they are an equality join. Two edits meet in the middle: one edit of the
   rare word against one inverse edit of the frequent word.
4. *Context.* Of several links the one wins whose frequency, edit cost and closeness to this place's context is best.
5. *Reflow.* A block that ends within a sentence is carried on by the next one, over furniture, notes and page ends.

Null texts, tables and repeated rows are left out; documents without a scanned page give no rows. A word without any
context has no vector and is linked by its glyphs alone. Words of more than ``longest`` characters are not corrected, by
default 200; None corrects words of any length.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Stages, join_hot

STRIP = ".,;:!?()[]\"'“”«»„"
SLOTS, MOST_SLOTS = 1 << 16, 1 << 18  # of the vector table: four per frequent word, within these bounds
DIM, WINDOW, NEGATIVE, EPOCHS = 24, 3, 2, 2
DRAWN = 32  # words drawn from the noise per step, weighing NEGATIVE words a pair
RATE, STEPS = 0.2, 32  # of AdaGrad; steps taken at least over the pairs held, however few
SLICES = 32
FAN = 64  # copies of a slice that one task averages
PAIRS = 1 << 22  # pairs that a training task holds before it learns from them
CONTEXT = 1.0  # weight of a place's closeness against a link's log frequency
NEAR = 0.0  # closeness above which a frequent word is a neighbour
BITS = 1 << 23  # of the maps of entries that spare rows which can join nothing
PAGES, PAGE_SHARE = 3, 3  # a recurring line stands on so many pages, and on one in so many
LONGEST_WORD = 200
CHUNK = 2048  # blocks of one document per window task
CLEAN_SHARE = 0.2  # of a word's uses that clean pages hold, below which the word is suspicious
RATIO = 6  # how much more frequent than a suspicious word its correction is
# glyphs or groups as they are read, and what they may stand for
GLYPHS = [
    ("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("ii", "ü"), ("u", "ii"), ("ri", "n"), ("n", "ri"), ("vv", "w"), ("w", "vv"), ("li", "h"), ("h", "li"), ("ln", "hi"), ("lc", "k"), ("tl", "d"), ("nn", "m"), ("in", "m"), ("ni", "m"),
    ("1", "l"), ("1", "i"), ("1", "I"), ("1", "í"), ("1", "t"), ("I", "l"), ("l", "I"), ("l", "i"), ("i", "l"), ("I", "i"), ("|", "i"), ("|", "l"), ("|", "I"), ("|", "t"), ("!", "l"), ("!", "i"), ("l", "t"), ("t", "l"), ("i", "í"), ("í", "i"), ("i", "j"), ("j", "i"),
    ("0", "o"), ("0", "O"), ("0", "ó"), ("0", "ö"), ("O", "o"), ("5", "s"), ("5", "S"), ("6", "é"), ("6", "b"), ("6", "ó"), ("6", "G"), ("8", "B"), ("9", "g"), ("4", "A"), ("2", "z"), ("2", "Z"), ("3", "S"),
    ("c", "e"), ("e", "c"), ("o", "a"), ("a", "o"), ("f", "t"), ("t", "f"), ("q", "g"), ("g", "q"), ("b", "h"), ("h", "b"), ("y", "v"), ("v", "y"), ("o", "e"), ("e", "o"), ("u", "n"), ("n", "u"), ("B", "ß"), ("ß", "B"), ("s", "a"), ("a", "s"), ("r", "n"), ("n", "r"), ("u", "v"), ("v", "u"), ("u", "ü"), ("o", "ö"), ("a", "ä"), ("e", "é"), ("c", "o"), ("o", "c"), ("e", "è"), ("o", "ó"), ("a", "á"), ("a", "à"), ("n", "ñ"), ("e", "ê"), ("i", "î"), ("u", "ú"), ("é", "e"), ("é", "6"), ("h", "k"), ("k", "h"), ("D", "O"), ("O", "D"), ("E", "F"), ("F", "E"), ("P", "F"), ("F", "P"), ("C", "G"), ("G", "C"), ("S", "5"), ("Z", "2"),
]
NOTE = re.compile(r"^(?:NOTE|CAUTION|WARNING|DANGER|ATTENTION|HINWEIS|ACHTUNG|WARNUNG|REMARQUE|AVERTISSEMENT|NOTA|ADVERTENCIA|PRECAUCIÓN)\b")
N = r"[0-9lIOo|Si]"
NUMBER = re.compile(rf"^[\s–—-]*(?:(?:page|seite|página|pagina|p\.)\s*)?(?:{N}{{1,4}}|(?:[A-Z]-)?{N}{{1,3}}\s?[-–]\s?{N}{{1,3}}|[ivxlIVXL1|]{{1,7}})(?:\s*(?:of|/|von|de|sur)\s*{N}{{1,4}})?[\s–—-]*$", re.I)
DATE = re.compile(r"[\dlIOoS|]{1,2}\.?\s+(?:\w{3,10})\s+[\dlIOoS|]{4}|[\dlIOo]{4}-[\dlIOo]{2}(?:-[\dlIOo]{2})?|(?:\w{3,10})\s+[\dlIOoS|]{4}")
BREAK = re.compile(r"[.!?,;:][\"'”’»)“]*\s")  # punctuation within a line
TERMINAL = re.compile(r"[.!?…:][\"'”’»)\]“]*$")
SHORT_NUMBER = re.compile(r"(?:^|[\s(\"“«'’])(?:no|nos|fig|figs|sec|para|rev|art|l'art|abs|abb|nr|núm|ca|approx|aprox|env|d'env|max|min|ok|рис|табл|п)\.$", re.I)  # a number follows
SHORT_WORD = re.compile(r"(?:^|[\s(\"“«'’])(?:cf|vgl|see|vs|dr|mr|mrs|ms|mme|st|sra?|esp|incl|e\.\s?g|i\.\s?e|z\.\s?b|d\.\s?h|p\.\s?ex|p\.\s?ej|u\.s|(?<!\d\s)[zdpei])\.$", re.I)  # a word follows
SHORT_NAME = re.compile(r"(?:^|\s)M\.$|(?:^|\s)(?:der|die|das|den|dem|des|am|vom|zum|im|bis|ab)\s\d{1,2}\.$", re.I)  # a name, or what is numbered
FOLD = str.maketrans({"1": "i", "l": "i", "|": "i", "!": "i", "0": "o", "a": "o", "5": "s", "6": "c", "e": "c", "é": "c", "f": "t", "q": "g", "b": "h", "v": "y", "ü": "u", "ö": "o", "ä": "o"})


@lru_cache(maxsize=100_000)
def fold(s: str) -> str:
    """A line with everything that is misread for each other written alike."""
    s = unicodedata.normalize("NFKC", s).lower().translate(FOLD)
    for a, b in (("rn", "m"), ("ci", "d"), ("ri", "n"), ("ii", "u"), ("yy", "w")):
        s = s.replace(a, b)
    return re.sub(r"\s+", " ", s).strip()


def is_header(line: str, title: str | None, filename: str | None, series: str | None) -> bool:
    """Nothing but the document's title and designation, dates, page numbers and what separates them; not all of it a
    number alone, which :data:`NUMBER` judges."""
    s = unicodedata.normalize("NFKC", line)
    hit = False
    stem = (filename or "").rsplit("/", 1)[-1].rsplit(".", 1)[0].rsplit("_", 1)[0]
    s2 = fold(re.sub(rf"(?<![\w|-]){N}{{1,4}}(?![\w|-])", " ", DATE.sub(" ", s)))
    for name in (title, stem, series):
        k = fold(name or "")
        if len(k) >= 4 and k in s2:
            s2 = s2.replace(k, " ", 1)
            hit = True
    return hit and len(re.sub(r"[\W_]+|(?<!\w)\w(?!\w)|[ios]{1,3}|\d+", "", s2)) <= 1


def edge_line(line: str, title: str | None, filename: str | None, series: str | None) -> tuple[bool, str] | None:
    """(furniture by itself, the key under which it may recur) of a trimmed line, or None if it is text for sure."""
    if line[-1] in ".?!:;,":
        return None
    direct = bool(NUMBER.match(line)) or is_header(line, title, filename, series)
    if not direct and (TERMINAL.search(line) or NOTE.match(line) or BREAK.search(line)):
        return None
    return direct, re.sub(r"[\dios]+", "#", fold(line))


def edges(lines: list[str], judge) -> list[tuple[int, bool, str]]:
    """(line, direct, key) of all lines that only possible furniture parts from the block's first or last line."""
    out: dict[int, tuple[bool, str]] = {}
    for way in (range(len(lines)), range(len(lines) - 1, -1, -1)):
        for i in way:
            line = lines[i].strip()
            if i in out or not line:
                continue
            got = judge(line)
            if got is None:
                break
            out[i] = got
    return [(i, *x) for i, x in sorted(out.items())]


def repair_lines(lines: list[str], flagged: set[int]) -> tuple[int, int]:
    """The range of lines that are text: furniture only goes from the edges inwards."""
    a, b = 0, len(lines)
    while a < b and (a in flagged or not lines[a].strip()):
        a += 1
    while b > a and (b - 1 in flagged or not lines[b - 1].strip()):
        b -= 1
    return a, b


def tokens(lines: list[str]) -> list[tuple[str, str]]:
    """(form, kind) of all words of a block's lines; kind 'b' joins a word broken at a line end, '-' is a last word that
    breaks off at the end of the block."""
    out = []
    rows = [ln.split() for ln in lines]
    rows = [r for r in rows if r]
    skip = False
    for i, r in enumerate(rows):
        for j, w in enumerate(r):
            if skip:
                skip = False
                continue
            if j == len(r) - 1 and len(w) > 1 and w.endswith("-") and w[-2].isalpha():
                if i + 1 < len(rows):
                    form = (w + rows[i + 1][0]).strip(STRIP)
                    out.append((form, "b"))
                    skip = True
                else:
                    out.append((w.strip(STRIP), "-"))
                continue
            f = w.strip(STRIP)
            if f:
                out.append((f, ""))
    return out


def _cost(a: str) -> float:
    return 0.5 if any(c in "0123456789|!" for c in a) else 1.0 if len(a) > 1 else 1.2


FROM: dict[str, list[tuple[str, float]]] = {}  # glyphs as read -> (as meant, cost); BACK the other way round
BACK: dict[str, list[tuple[str, float]]] = {}
for _a, _b in GLYPHS:
    FROM.setdefault(_a, []).append((_b, _cost(_a)))
    BACK.setdefault(_b, []).append((_a, _cost(_a)))
LONGEST = max(map(len, FROM | BACK))


def _edit(w: str, table: dict[str, list[tuple[str, float]]]) -> dict[str, float]:
    out: dict[str, float] = {}
    for i in range(len(w)):
        for n in range(1, min(LONGEST, len(w) - i) + 1):
            for to, c in table.get(w[i : i + n], ()):
                x = w[:i] + to + w[i + n :]
                if c < out.get(x, 9e9):
                    out[x] = c
    return out


def variants(form: str) -> dict[str, float]:
    """What one glyph edit makes of a word, with its cost."""
    out = _edit(form, FROM)
    n = unicodedata.normalize("NFKC", form)
    if n != form:
        out[n] = 0.2
    out.pop(form, None)
    return out


def wholes(form: str) -> list[str]:
    """What a word broken at a line end may be without the hyphen."""
    cuts = [m.start() for m in re.finditer("-", form)]
    last = form.rfind("-", 0, -1)
    return [form[:k] + form[k + 1 :] for k in cuts if k == last or len(cuts) == 1]


def lookups(form: str, kind: str) -> list[tuple[str, str, float]]:
    """(entry to look up, text it would repair to, cost) for a suspicious form, by one glyph edit, joining or splitting."""
    out: dict[tuple[str, str], float] = {}

    def add(entry: str, text: str, cost: float) -> None:
        if cost < out.get((entry, text), 9e9):
            out[entry, text] = cost
        low = entry[:1].lower() + entry[1:]
        if low != entry and cost + 0.3 < out.get((low, text), 9e9):
            out[low, text] = cost + 0.3

    if kind:  # broken: without the hyphen, or with it, perhaps misread besides
        for whole in wholes(form):
            add(whole, whole, 0.0)
            for v, c in variants(whole).items():
                add(v, v, 1.0 + c)
        add(form, form, 0.0)
        for v, c in variants(form).items():
            add(v, v, 1.0 + c)
    else:
        for v, c in variants(form).items():
            add(v, v, c)
        for k in range(1, len(form)):
            if form[k - 1] != "-" and form[k] != "-":
                a, b = form[:k].rstrip(STRIP), form[k:].lstrip(STRIP)
                if a and b:
                    add(f"{a} {b}", f"{form[:k]} {form[k:]}", 1.0)
    return [(e, t, c) for (e, t), c in out.items()]


def halfway(form: str, kind: str) -> dict[str, float]:
    """The words one edit away from a suspicious form, from where a second edit may lead to a frequent word."""
    if not kind:
        return _edit(form, FROM)
    out: dict[str, float] = {}
    for whole in wholes(form):
        for m, c in _edit(whole, FROM).items():
            out[m] = min(out.get(m, 9e9), 1.0 + c)
    return out


def sources(entry: str) -> list[tuple[str, str, float]]:
    """(word, text, cost): the words from which one edit leads to a frequent word, or to it with a capital."""
    out = [(m, entry, c) for m, c in _edit(entry, BACK).items()]
    if entry[:1].islower() and len(entry[:1].upper()) == 1:
        big = entry[:1].upper() + entry[1:]
        out += [(m, big, c + 0.3) for m, c in _edit(big, BACK).items()]
    return out


def _slot(w: str, slots: int = SLOTS) -> int:
    return zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) & (slots - 1)


def slots_for(words: int) -> int:
    """Slots of the vector table for so many frequent words: a power of two, four per word within the bounds."""
    return max(SLOTS, min(MOST_SLOTS, 1 << max(0, math.ceil(math.log2(max(1, 4 * words))))))


def start_tables(slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(1)
    return rng.uniform(-0.1, 0.1, (slots, DIM)).astype(np.float32), rng.uniform(-0.1, 0.1, (slots, DIM)).astype(np.float32)


def train_skipgram(sentences: Iterator[np.ndarray], v: np.ndarray, u: np.ndarray, freq: np.ndarray, rate: float = RATE, batch: int = 8192, seed: int = 0) -> np.ndarray:
    """Skip-gram with negative sampling over arrays of slots, in place, with steps by AdaGrad. A pair that occurs often is
    one step with that weight. Returns the words seen per slot."""
    rng, slots = np.random.default_rng(seed), len(v)
    noise = np.cumsum(freq**0.75)
    noise /= noise[-1] if noise[-1] else 1
    keep = np.minimum(1.0, np.sqrt(1e-3 * max(freq.sum(), 1) / np.maximum(freq, 1)))
    acc_v, acc_u, seen = np.full(slots, 0.1, np.float32), np.full(slots, 0.1, np.float32), np.zeros(slots)

    def move(table: np.ndarray, acc: np.ndarray, at: np.ndarray, grad: np.ndarray) -> None:
        order = np.argsort(at, kind="stable")
        s = at[order]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        g, r = np.add.reduceat(grad[order], first, axis=0), s[first]
        acc[r] += (g * g).mean(1)
        table[r] += rate * g / np.sqrt(acc[r])[:, None]

    def step(c: np.ndarray, o: np.ndarray, times: np.ndarray) -> None:
        """Pairs against each other, and all of them against the same few words drawn from the noise."""
        neg = np.searchsorted(noise, rng.random(DRAWN)).clip(0, slots - 1)
        vc, uo, un = v[c], u[o], u[neg]
        near = times / (1 + np.exp(np.clip(np.einsum("nd,nd->n", vc, uo), -8, 8)))
        far = -(times * np.float32(NEGATIVE / DRAWN))[:, None] / (1 + np.exp(np.clip(-(vc @ un.T), -8, 8)))
        move(v, acc_v, c, near[:, None] * uo + far @ un)
        move(u, acc_u, np.concatenate([o, neg]), np.concatenate([near[:, None] * vc, far.T @ vc]))

    def flush(held: list[np.ndarray]) -> None:
        pair, times = np.unique(np.concatenate(held), return_counts=True)
        size = min(batch, max(64, len(pair) // STEPS))
        for _ in range(math.ceil(STEPS / math.ceil(len(pair) / size))):
            order = rng.permutation(len(pair))
            for i in range(0, len(order), size):
                at = order[i : i + size]
                step(pair[at] // slots, pair[at] % slots, times[at].astype(np.float32))

    def pairs(chunk: list[np.ndarray]) -> Iterator[np.ndarray]:
        """Pairs of words at most WINDOW apart in the same block, frequent words thinned out first."""
        a = np.concatenate(chunk)
        block = np.repeat(np.arange(len(chunk)), [len(x) for x in chunk])
        seen[:] += np.bincount(a, minlength=slots)
        kept = rng.random(len(a)) < keep[a]
        a, block = a[kept], block[kept]
        for d in range(1, WINDOW + 1):
            same = block[d:] == block[:-d]
            x, y = a[:-d][same], a[d:][same]
            yield x * slots + y
            yield y * slots + x

    held: list[np.ndarray] = []
    chunk: list[np.ndarray] = []
    n = words = 0
    for a in sentences:
        chunk.append(a)
        words += len(a)
        if words >= PAIRS // 16:
            held += pairs(chunk)
            chunk, words, n = [], 0, sum(map(len, held))
            if n >= PAIRS:
                flush(held)
                held, n = [], 0
    if words:
        held += pairs(chunk)
    if sum(map(len, held)):
        flush(held)
    return seen


def learn_vectors(spark, text: DataFrame, freq: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Skip-gram tables from all blocks (slots array<int>). Partitions train copies; a slot's copies are averaged with
    the words seen in that slot as weights, ``FAN`` copies a task, level by level."""
    slots = len(freq)
    v, u = start_tables(slots)
    per = slots // SLICES
    schema = "slice int, lane int, at binary, n binary, v binary, u binary"
    lanes = text.rdd.getNumPartitions()

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        """Sums of copies; each holds the slots that its words touched."""
        n, a, b = np.zeros(per), np.zeros((per, DIM)), np.zeros((per, DIM))
        for x in pdf.itertuples(index=False):
            at = np.frombuffer(x.at, np.int32)
            n[at] += np.frombuffer(x.n, np.float32)
            a[at] += np.frombuffer(x.v, np.float32).reshape(-1, DIM)
            b[at] += np.frombuffer(x.u, np.float32).reshape(-1, DIM)
        return pd.DataFrame([(int(pdf["slice"].iloc[0]), int(pdf["lane"].iloc[0]), *pack(n, a, b))], columns=["slice", "lane", "at", "n", "v", "u"])

    def pack(n: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[bytes, ...]:
        at = np.flatnonzero(n)
        return (at.astype(np.int32).tobytes(), *(x[at].astype(np.float32).tobytes() for x in (n, a, b)))

    for ep in range(epochs):
        shared = spark.sparkContext.broadcast((v, u, freq.astype(np.float32)))

        def run(batches: Iterator[pd.DataFrame], shared=shared, ep=ep) -> Iterator[pd.DataFrame]:
            v0, u0, f = shared.value
            a, b = v0.copy(), u0.copy()
            lane = TaskContext.get().partitionId()
            sents = (np.asarray(x, np.int64) for pdf in batches for x in pdf["slots"])
            n = train_skipgram(sents, a, b, f.astype(np.float64), seed=ep * 1_000_003 + lane)
            rows = [(s, lane // FAN, *pack(n[sl], a[sl] * n[sl, None], b[sl] * n[sl, None])) for s in range(SLICES) for sl in (slice(s * per, (s + 1) * per),) if n[sl].any()]
            yield pd.DataFrame(rows, columns=["slice", "lane", "at", "n", "v", "u"])

        parts, left = text.select("slots").mapInPandas(run, schema), lanes
        while True:
            parts = parts.groupBy("slice", "lane").applyInPandas(add, schema)
            left = math.ceil(left / FAN)
            if left <= 1:
                break
            parts = parts.withColumn("lane", F.floor(F.col("lane") / FAN).cast("int"))
        for r in parts.collect():
            at = r["slice"] * per + np.frombuffer(r["at"], np.int32)
            n = np.frombuffer(r["n"], np.float32)[:, None]
            v[at] = np.frombuffer(r["v"], np.float32).reshape(-1, DIM) / n
            u[at] = np.frombuffer(r["u"], np.float32).reshape(-1, DIM) / n
        shared.unpersist()
    return v, u


class Space:
    """The learned vectors, and how close frequent words are to a context on average."""

    def __init__(self, v: np.ndarray, u: np.ndarray, freq: np.ndarray):
        often = v[np.flatnonzero(freq >= 5)] if (freq >= 5).any() else v
        self.u, self.w = u, v - often.mean(0)
        self.cov = np.atleast_2d(np.cov(often.T)) if len(often) > 1 else np.zeros((DIM, DIM))

    def closeness(self, context: np.ndarray, texts: list[str]) -> np.ndarray:
        """Of each context (the sum or mean of its words' u) to the vector of a text, in standard deviations over frequent
        words; 0 where nothing is learned. The closest of a text's words counts."""
        spread = np.sqrt(np.maximum(np.einsum("nd,de,ne->n", context, self.cov, context), 0))
        got = np.zeros(len(texts))
        for i, t in enumerate(texts):
            ws = [x for x in (w.strip(STRIP) for w in t.split()) if x]
            if ws and spread[i] > 1e-9:
                got[i] = max(float(context[i] @ self.w[_slot(w, len(self.w))]) for w in ws) / spread[i]
        return got


def entry_map(df: DataFrame, c: str) -> np.ndarray:
    """A bit map of fixed size of a string column's values: what is not in it joins nothing."""
    h = F.crc32(F.col(c).cast("binary")).bitwiseAND(F.lit(BITS - 1))
    out = np.zeros(BITS // 8, np.uint8)
    per = 32_768
    for r in df.select(h.alias("h")).groupBy(F.floor(F.col("h") / per).alias("b")).agg(F.bitmap_construct_agg(F.col("h") % per).alias("m")).collect():
        bits = np.frombuffer(bytes(r["m"]), np.uint8)
        out[r["b"] * per // 8 : r["b"] * per // 8 + len(bits)] = bits
    return out


def in_map(bits: np.ndarray, w: str) -> bool:
    h = zlib.crc32(w.encode("utf-8", "surrogatepass")) & (BITS - 1)
    return bool(bits[h >> 3] >> (h & 7) & 1)


def _lead(df: DataFrame, order: str, cols: list[str], keep: Column) -> DataFrame:
    """Adds next_<c>: the values of ``cols`` in the document's next row with ``keep``, by ``order``. Windows run over
    chunks of a document; a chunk's last rows look up the first such row of the chunks after it."""
    df = df.withColumn("_chunk", F.floor(F.col(order) / CHUNK).cast("long")).withColumn("_keep", keep)
    one = F.when(F.col("_keep"), F.struct(F.col(order).alias("_o"), *cols))
    w = Window.partitionBy("doc_id", "_chunk").orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    x = df.withColumn("_next", F.first(one, ignorenulls=True).over(w))
    heads = df.where("_keep").groupBy("doc_id", "_chunk").agg(F.min_by(F.struct(F.col(order).alias("_o"), *cols), order).alias("_head"))
    chunks = df.select("doc_id", "_chunk").distinct().join(heads, ["doc_id", "_chunk"], "left")
    wc = Window.partitionBy("doc_id").orderBy("_chunk").rowsBetween(1, Window.unboundedFollowing)
    chunks = chunks.withColumn("_later", F.first("_head", ignorenulls=True).over(wc)).drop("_head")
    x = x.join(chunks, ["doc_id", "_chunk"], "left").withColumn("_next", F.coalesce("_next", "_later"))
    return x.select(*[c for c in df.columns if c not in ("_chunk", "_keep")], *[F.col("_next")[c].alias("next_" + c) for c in cols])


def repair(blocks: DataFrame, documents: DataFrame, longest: int | None = LONGEST_WORD) -> dict[str, DataFrame]:
    """All repairs of the blocks' text. Keys of the result:

    ``found``: (block_id, kind, damaged, repaired) as TESTDATA.md states them for problem 1. ``clean``: (block_id, doc_id,
    seq, page, kind, lines, scanned, joins): what remains of each block's lines, and the block it carries on.
    """
    spark = blocks.sparkSession
    st = Stages(spark, "scans")
    b = blocks.where("block_id is not null and text is not null and (kind is null or kind <> 'table')").select("block_id", "doc_id", F.coalesce("seq", F.lit(0)).alias("seq"), F.coalesce("page", F.lit(0)).alias("page"), F.coalesce("kind", F.lit("text")).alias("kind"), "text")
    b = b.groupBy("block_id").agg(F.min(F.struct("doc_id", "seq", "page", "kind", "text")).alias("m")).select("block_id", "m.*")
    docs = documents.select(F.col("doc_id").alias("d_id"), "title", "filename", "series").groupBy("d_id").agg(F.first("title").alias("title"), F.first("filename").alias("filename"), F.first("series").alias("series"))
    b = st.put(join_hot(b, docs, "doc_id", "d_id", "left").drop("d_id"))

    def edge_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                if r.kind == "text":
                    for i, direct, key in edges(r.text.split("\n"), lambda line, r=r: edge_line(line, r.title, r.filename, r.series)):
                        rows.append((r.block_id, r.doc_id, r.page, i, direct, key))
            yield pd.DataFrame(rows, columns=["block_id", "doc_id", "page", "line_no", "direct", "key"])

    e = st.put(b.mapInPandas(edge_rows, "block_id long, doc_id long, page int, line_no int, direct boolean, key string"))
    seen = e.where(~F.col("direct")).select("doc_id", "key", "page").distinct().groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= PAGES)
    pages = b.select("doc_id", "page").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"))
    often = seen.join(pages, "doc_id").where(F.col("n") * PAGE_SHARE >= F.col("n_pages")).select("doc_id", "key", F.lit(True).alias("often"))
    flagged = e.join(often, ["doc_id", "key"], "left").where(F.col("direct") | F.coalesce("often", F.lit(False)))
    flagged = flagged.groupBy("block_id").agg(F.collect_set("line_no").alias("flagged")).withColumnRenamed("block_id", "f_id")  # lines of one block
    c = b.join(flagged, F.col("block_id") == F.col("f_id"), "left")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                lines = r.text.split("\n")
                x, y = repair_lines(lines, set() if r.flagged is None else set(r.flagged))
                furn = [ln.strip() for ln in lines[:x] + lines[y:] if ln.strip()]
                body = [ln for ln in lines[x:y] if ln.strip()]
                note = len(body) == 1 and bool(NOTE.match(body[0].strip()))
                rows.append((r.block_id, r.doc_id, r.seq, r.page, r.kind, body, furn, len(lines) > 1, note))
            yield pd.DataFrame(rows, columns=["block_id", "doc_id", "seq", "page", "kind", "lines", "furniture", "broke", "note"])

    schema = "block_id long, doc_id long, seq int, page int, kind string, lines array<string>, furniture array<string>, broke boolean, note boolean"
    c = st.put(c.select("block_id", "doc_id", "seq", "page", "kind", "text", "flagged").mapInPandas(split, schema))
    st.drop(b, e)
    split_ = c
    scan = c.groupBy("doc_id", "page").agg(F.max(F.col("broke") | (F.size("furniture") > 0)).alias("scanned"))
    c = st.put(c.join(scan, ["doc_id", "page"]))
    st.drop(split_)
    # the next block of the text flow
    body = c.where(F.size("lines") > 0)
    flow = F.col("kind").isin("text", "heading") & ~F.col("note")
    tail, head = F.trim(F.element_at("lines", -1)), F.trim(F.element_at("lines", 1))
    seqd = _lead(body.select("block_id", "doc_id", F.struct("seq", "block_id").alias("ord"), "seq", "page", "kind", "scanned", "note", tail.alias("tail"), head.alias("head")), "seq", ["block_id", "page", "kind", "head"], flow)

    def carries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                t, h = r.tail, r.next_head
                first = h.lstrip("\"'“„«([¿¡")[:1]
                breaks = len(t) > 1 and t.endswith("-") and t[-2].isalpha()
                short = SHORT_WORD.search(t) or (SHORT_NUMBER.search(t) and first.isdigit()) or (SHORT_NAME.search(t) and first.isalnum() and not first.islower())
                open_end = not TERMINAL.search(t) or bool(short) or breaks
                if open_end or (first.islower() and not h.startswith(("i.e.", "e.g."))):
                    before, after = t.split(), h.split()
                    raw = before[-1] + after[0] if breaks else ""
                    around = [w for w in (x.strip(STRIP) for x in before[-1 - WINDOW : -1] + after[1 : 1 + WINDOW]) if w] if breaks else []
                    rows.append((int(r.next_block_id), int(r.block_id), raw.strip(STRIP), raw, around))
            yield pd.DataFrame(rows, columns=["block_id", "earlier", "word", "raw", "around"])

    cand = seqd.where("kind = 'text' and not note and next_kind = 'text' and next_block_id is not null and scanned and next_page > page")
    joins = st.put(cand.select("block_id", "tail", "next_block_id", "next_head").mapInPandas(carries, "block_id long, earlier long, word string, raw string, around array<string>"))
    # words: counts of forms and pairs, apart for clean pages
    crossed = joins.where("word <> ''").select(F.col("earlier").alias("x_id"), F.lit(True).alias("cut_end"))
    entered = joins.where("word <> ''").select(F.col("block_id").alias("y_id"), F.lit(True).alias("cut_start"))
    body = body.join(crossed, F.col("block_id") == F.col("x_id"), "left").join(entered, F.col("block_id") == F.col("y_id"), "left").select("block_id", "lines", "scanned", F.coalesce("cut_end", F.lit(False)).alias("cut_end"), F.coalesce("cut_start", F.lit(False)).alias("cut_start"))
    body = st.put(body)

    def tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [tokens(list(lines))[1 if cs else 0 :] for lines, cs in zip(pdf["lines"], pdf["cut_start"], strict=True)]
            yield pd.DataFrame({"block_id": pdf["block_id"], "scanned": pdf["scanned"], "forms": [[w for w, _ in ts] for ts in got], "kinds": [[k for _, k in ts] for ts in got]})

    tok = st.put(body.mapInPandas(tokenise, "block_id long, scanned boolean, forms array<string>, kinds array<string>"))
    st.drop(body)
    words1 = tok.select("scanned", F.explode(F.arrays_zip("forms", "kinds")).alias("t")).where("t.kinds = ''").select("scanned", F.col("t.forms").alias("w"))
    both = F.arrays_zip(F.slice("forms", F.lit(1), F.size("forms") - 1).alias("a"), F.slice("forms", F.lit(2), F.size("forms") - 1).alias("b"), F.slice("kinds", F.lit(1), F.size("forms") - 1).alias("x"), F.slice("kinds", F.lit(2), F.size("forms") - 1).alias("y"))
    pairs = tok.where(~F.col("scanned") & (F.size("forms") > 1)).select(F.explode(both).alias("t")).select("t.*").where("x = '' and y = ''")
    n1 = words1.groupBy("w").agg(F.count_if(~F.col("scanned")).alias("n_clean"), F.count(F.lit(1)).alias("n"))
    n2 = pairs.groupBy(F.concat_ws(" ", "a", "b").alias("w")).agg(F.count(F.lit(1)).alias("n_clean")).withColumn("n", F.col("n_clean"))
    lex = st.put(n1.unionByName(n2))
    sure = lex.where((F.col("n_clean") >= 2) & (F.col("n_clean") >= CLEAN_SHARE * F.col("n")))
    slots = slots_for(sure.where(~F.col("w").contains(" ")).count())
    hashed = lambda w: F.crc32(F.lower(w).cast("binary")).bitwiseAND(F.lit(slots - 1)).cast("int")
    freq = np.zeros(slots)
    for r in lex.where(~F.col("w").contains(" ")).groupBy(hashed(F.col("w")).alias("s")).agg(F.sum("n").alias("n")).collect():
        freq[r["s"]] = r["n"]
    plain = tok
    tok = tok.withColumn("slots", F.transform("forms", hashed))
    v, u = learn_vectors(spark, tok, freq)
    space = spark.sparkContext.broadcast(Space(v, u, freq))
    # doubtful words of scanned pages, with the slots of the words around them
    common = [r["w"] for r in sure.where(~F.col("w").contains(" ")).orderBy(F.desc("n"), "w").limit(2000).select("w").collect()]
    p = F.col("p")
    near = F.concat(F.slice("slots", F.greatest(F.lit(1), p + 1 - WINDOW), F.least(p, F.lit(WINDOW))), F.slice("slots", p + 2, F.lit(WINDOW)))
    short = F.length("form") <= longest if longest else F.lit(True)
    occ = tok.where("scanned").select("block_id", "slots", F.posexplode(F.arrays_zip("forms", "kinds")).alias("p", "t")).select("block_id", F.col("t.forms").alias("form"), F.col("t.kinds").alias("broken"), "slots", "p")
    occ = occ.where("broken <> '-'").where((F.col("broken") == "b") | (~F.col("form").isin(common) & F.col("form").rlike(r"\p{L}.*\p{L}")))
    occ = occ.select("block_id", "form", "broken", near.alias("around"))
    whole = lex.where(~F.col("w").contains(" ")).select(F.col("w").alias("l_w"), F.col("n").alias("l_n"), F.col("n_clean").alias("l_clean"))
    cross = joins.where("word <> ''").select(F.col("earlier").alias("block_id"), F.col("word").alias("form"), F.lit("b").alias("broken"), F.transform("around", hashed).alias("around"))
    occ = occ.unionByName(cross).join(whole, F.col("form") == F.col("l_w"), "left")
    doubtful = (F.col("broken") == "b") | ~((F.coalesce("l_clean", F.lit(0)) >= 2) & (F.col("l_clean") >= CLEAN_SHARE * F.col("l_n")))
    occ = st.put(occ.where(doubtful).select("block_id", "form", "broken", "around", F.coalesce("l_n", F.lit(0)).alias("form_n")))

    st.drop(plain)
    # a rare word's vector: the sum of its contexts, over all its places
    dims = [f"c{i}" for i in range(DIM)]

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ut = space.value.u
        for pdf in batches:
            got = np.array([ut[x].sum(0) if len(x) else np.zeros(DIM, np.float32) for x in pdf["around"]], np.float32).reshape(-1, DIM)
            out = pd.DataFrame(got, columns=dims)
            for c_ in ("form", "broken", "form_n"):
                out[c_] = pdf[c_].to_numpy()
            out["k"] = [len(x) for x in pdf["around"]]
            yield out.groupby(["form", "broken", "form_n"], as_index=False).sum()

    ctx = occ.where(short).mapInPandas(contexts, ", ".join(f"{x} float" for x in dims) + ", form string, broken string, form_n long, k long")
    forms = st.put(ctx.groupBy("form", "broken", "form_n").agg(F.sum("k").alias("k"), *[F.sum(x).cast("float").alias(x) for x in dims]))
    width = max(spark.sparkContext.defaultParallelism, forms.count() // 20_000)
    single = sure.where(~F.col("w").contains(" ") & (F.col("n_clean") >= 3)).select("w")
    entries = spark.sparkContext.broadcast(entry_map(sure, "w"))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list = []
            for f, k, n in zip(pdf["form"], pdf["broken"], pdf["form_n"], strict=True):
                rows += [(f, k, n, *x) for x in lookups(f, k) if in_map(entries.value, x[0])]
            yield pd.DataFrame(rows, columns=["form", "broken", "form_n", "entry", "text", "cost"])

    def half(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(f, k, n, m, c_) for f, k, n in zip(pdf["form"], pdf["broken"], pdf["form_n"], strict=True) for m, c_ in halfway(f, k).items()]
            yield pd.DataFrame(rows, columns=["form", "broken", "form_n", "mid", "cost"])

    def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            z = space.value.closeness(pdf[dims].to_numpy(np.float64), list(pdf["entry"]))
            yield pdf.loc[(z > NEAR) | (pdf["k"] == 0).to_numpy(), ["form", "broken", "text", "score"]]

    def nominate(x: DataFrame) -> DataFrame:
        """Of glyph links (form, broken, form_n, entry, text, cost) those to frequent neighbours of the form."""
        x = x.join(sure.select(F.col("w").alias("entry"), F.col("n_clean").alias("c_n")).hint("merge"), "entry")
        x = x.where((F.col("broken") == "b") | (F.col("c_n") >= RATIO * F.col("form_n")) & ((F.col("c_n") >= 3) | F.col("entry").contains(" ")))
        # a pair's count is of two words standing together, so it weighs more than a single word's
        x = x.withColumn("score", F.log(F.col("c_n") + 1.0) - 2.0 * F.col("cost") + F.when(F.col("entry").contains(" "), 2.0).otherwise(0.0))
        x = x.select("form", "broken", "text", "entry", "score").join(forms.drop("form_n"), ["form", "broken"])
        x = x.mapInPandas(neighbours, "form string, broken string, text string, score double")
        return st.put(x.groupBy("form", "broken", "text").agg(F.max("score").alias("score")))

    key = "form string, broken string, form_n long"
    one = nominate(forms.select("form", "broken", "form_n").repartition(width).mapInPandas(look, key + ", entry string, text string, cost double"))
    mids = st.put(forms.select("form", "broken", "form_n").join(one.select("form", "broken").distinct(), ["form", "broken"], "left_anti").repartition(width).mapInPandas(half, key + ", mid string, cost double"))
    wanted = spark.sparkContext.broadcast(entry_map(mids, "mid"))

    def back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(w, *x) for w in pdf["w"] for x in sources(w) if in_map(wanted.value, x[0])]
            yield pd.DataFrame(rows, columns=["entry", "b_mid", "text", "b_cost"])

    ends = (single if longest is None else single.where(F.length("w") <= longest + 2)).repartition(width).mapInPandas(back, "entry string, b_mid string, text string, b_cost double")
    two = mids.join(ends, F.col("mid") == F.col("b_mid")).where(F.col("text") != F.col("form"))
    two = nominate(two.groupBy("form", "broken", "form_n", "entry", "text").agg(F.min(F.col("cost") + F.col("b_cost") + 1.0).alias("cost")))
    links = st.put(one.unionByName(two).groupBy("form", "broken").agg(F.sort_array(F.collect_list(F.struct("text", "score"))).alias("links")))
    linked = occ.join(links, ["form", "broken"], "left")

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, f, k, around, ls in zip(pdf["block_id"], pdf["form"], pdf["broken"], pdf["around"], pdf["links"], strict=True):
                text = None
                if ls is not None:
                    texts, score = [x["text"] for x in ls], np.array([x["score"] for x in ls])
                    if len(texts) > 1 and len(around):
                        here = space.value.u[around].mean(0, dtype=np.float64)
                        score = score + CONTEXT * space.value.closeness(np.repeat(here[None], len(texts), 0), texts)
                    text = texts[len(texts) - 1 - int(np.argmax(score[::-1]))]
                if text is None and k == "b":
                    j = f.rfind("-", 0, -1)
                    text = f if j < 0 else f[:j] + f[j + 1 :]
                if text is not None and (k == "b" or text != f):
                    rows.append((i, f, text))
            yield pd.DataFrame(rows, columns=["block_id", "damaged", "repaired"])

    words = linked.select("block_id", "form", "broken", "around", "links").mapInPandas(choose, "block_id long, damaged string, repaired string")
    lines_ = c.select("block_id", F.explode("furniture").alias("damaged"))
    found = (
        lines_.select("block_id", F.lit("line").alias("kind"), "damaged", F.lit("").alias("repaired"))
        .unionByName(words.select("block_id", F.lit("word").alias("kind"), "damaged", "repaired"))
        .unionByName(joins.select("block_id", F.lit("join").alias("kind"), F.col("earlier").cast("string").alias("damaged"), F.lit("").alias("repaired")))
        .distinct()
    )
    return {"found": found, "clean": c, "joins": joins, "links": links, "lexicon": lex, "words": words.distinct()}


def heal(lines: list[str], fixes: dict[str, str], drop_first: bool = False) -> str:
    """A block's lines as one text, with its repairs put in."""
    rows = [r for r in (ln.split() for ln in lines) if r]
    out: list[str] = []
    skip = drop_first
    for i, r in enumerate(rows):
        for j, w in enumerate(r):
            if skip:
                skip = False
                continue
            if j == len(r) - 1 and i + 1 < len(rows) and len(w) > 1 and w.endswith("-") and w[-2].isalpha():
                w, skip = w + rows[i + 1][0], True
            f = w.strip(STRIP)
            out.append(w.replace(f, fixes[f], 1) if f and f in fixes else w)
    return " ".join(out)


def paragraphs(res: dict[str, DataFrame]) -> DataFrame:
    """(doc_id, paragraph, kind, text): each document's text as continuous paragraphs in reading order, furniture gone.

    ``paragraph`` is the first block's id. A paragraph is put together in one task; a document is not.
    """
    c = res["clean"].where(F.size("lines") > 0)
    j = res["joins"].select(F.col("block_id").alias("j_id"), F.col("word").alias("entered"))
    left = res["joins"].where("word <> ''").select(F.col("earlier").alias("e_id"), F.col("word").alias("crosses"), "raw")
    fixes = res["words"].groupBy(F.col("block_id").alias("w_id"), "damaged").agg(F.min("repaired").alias("repaired")).groupBy("w_id").agg(F.map_from_entries(F.collect_list(F.struct("damaged", "repaired"))).alias("fixes"))
    x = c.join(j, F.col("block_id") == F.col("j_id"), "left").join(left, F.col("block_id") == F.col("e_id"), "left").join(fixes, F.col("block_id") == F.col("w_id"), "left")
    x = x.withColumn("flow", F.col("kind").isin("text", "heading") & ~F.col("note")).withColumn("_chunk", F.floor(F.col("seq") / CHUNK))
    # blocks of the flow since the last start of a paragraph share its number; other blocks stand by themselves
    start = F.when(F.col("flow") & F.col("j_id").isNull(), F.col("block_id"))
    w = Window.partitionBy("doc_id", "_chunk").orderBy("seq", "block_id").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_start", F.last(start, ignorenulls=True).over(w))
    ends = x.groupBy("doc_id", "_chunk").agg(F.max_by("_start", F.when(F.col("_start").isNotNull(), F.col("seq"))).alias("_e"))
    wc = Window.partitionBy("doc_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    x = x.join(ends.withColumn("_before", F.last("_e", ignorenulls=True).over(wc)).drop("_e"), ["doc_id", "_chunk"], "left")
    x = x.withColumn("paragraph", F.when(F.col("flow"), F.coalesce("_start", "_before", "block_id")).otherwise(F.col("block_id")))

    def text_of(r, first: bool) -> str:
        f = dict(r.fixes) if r.fixes is not None else {}
        t = heal(list(r.lines), f, bool(r.entered) and not first)
        if r.crosses and t:  # its last word ends in the next block
            t = f"{t.rpartition(' ')[0]} {r.raw.replace(r.crosses, f.get(r.crosses, r.crosses), 1)}".strip()
        return t

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "paragraph", "seq", "kind", "text"]
        now: list | None = None
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                if now is None or (now[0], now[1]) != (r.doc_id, r.paragraph):
                    if now is not None:
                        rows.append((*now[:4], " ".join(p for p in now[4] if p)))
                    now = [r.doc_id, r.paragraph, r.seq, r.kind, [text_of(r, True)]]
                else:
                    now[4].append(text_of(r, False))
            yield pd.DataFrame(rows, columns=names)
        if now is not None:
            yield pd.DataFrame([(*now[:4], " ".join(p for p in now[4] if p))], columns=names)

    cols = x.select("doc_id", "paragraph", "seq", "block_id", "kind", "lines", "fixes", "entered", "crosses", "raw")
    return cols.repartition("doc_id", "paragraph").sortWithinPartitions("doc_id", "paragraph", "seq", "block_id").mapInPandas(put, "doc_id long, paragraph long, seq int, kind string, text string")
