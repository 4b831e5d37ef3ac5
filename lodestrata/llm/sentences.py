"""Sentence units of documents in many languages and scripts, by semi-Markov dynamic programming.

A document is cut into blocks at blank lines, and blocks into heading lines, list lines and paragraphs. In a paragraph
every place where a sentence might end is a candidate; the best sequence of *whole spans* between candidates is found
by dynamic programming over a score of four parts: the span's length, how its first words open and how its last words
close sentences, and whether its quotations and brackets balance.

Opening and closing words are learned from all documents without labels: the first and last words of paragraphs are
known edges, and words that stand beside a mark (in scripts without marks: beside a space) but never at an edge are
evidence against. The counts are hashed into a table of fixed size, so what is broadcast does not grow with the data.

Null and blank texts give no unit. Offsets are code points, end exclusive, without surrounding white space. A text
without blank lines is one block however long it is; the programme is linear in its candidates (``MAX_SPAN`` is the
longest sentence in candidates that is weighed, after which the best cut so far is taken).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 18
LONG, SLOPE, NESTED = 300, 0.0004, 7.0  # characters from which a span costs SLOPE each; cost of each unbalanced mark

# Words before a full stop that do not end a sentence by themselves, and those that may if a sentence opens after them.
NEVER = set(
    "dr mr mrs ms mme mlle m prof st sr sra srta dra herr fr no nos nr núm num n° fig figs abb abs art arts sec sect par para paras ch chap vol pp p pg ref rev tab tbl eq "
    "cf vgl s see ca approx aprox env ok max min vs e.g i.e eg ie esp incl excl z.b d.h u.a p.ex p.ej t.e viz al bzw ggf inkl evtl sog vorb "
    "см рис табл п пп ст стр гл им ул т.е ок напр тел тыс млн млрд "
    "gen col lt capt sgt rep sen gov hon pres dept univ est ext "
    "डॉ श्री प्रो ".split()
)
MAYBE = set("etc usw u.s u.k u.n e.u a.m p.m inc ltd co corp bros jr sr. std град т.д т.п др usf ff et.al ll.c s.a gmbh".split())
OPEN, CLOSE = "([{«“「『（【〈《‹„", ")]}»”」』）】〉》›“"
PAIR = dict(zip(OPEN, CLOSE, strict=True))
NEST = re.compile("[" + re.escape(OPEN + CLOSE) + '"]')
CLOSE = CLOSE[:-1]  # “ closes „ only; elsewhere it opens
STRONG = "。！？｡।॥۔"
MARK = re.compile(r"[.!?؟…。！？｡।॥۔]+")
LIST = re.compile(r"\s*(?:[-–—*+•·‣▪●○◦]|\(?(?:\d{1,3}|[a-z]|[ivx]{1,4})[.)]|\d{1,2}(?:\.\d{1,2}){1,5}\.?)\s+(?=\S)")
BULLET = re.compile(r"\s*(?:[-–—*+•·‣▪●○◦]|\(?(?:\d{1,3}|[a-z]|[ivx]{1,4})\)|[a-z]\.)\s+(?=\S)")
HASH = re.compile(r"\s*#{1,6}\s")
ENDED = re.compile(r"[.!?؟…。！？｡।॥۔:;,][\"'”’»)\]」』）]*\s*$")
CODEISH = re.compile(r"[a-z]+[A-Z]|[_/()=]|\d|\w\.\w|^\.\w")


def _slot(kind: str, word: str) -> int:
    return zlib.crc32(f"{kind}\0{word}".encode("utf-8", "surrogatepass")) & (SLOTS - 1)


def _norm(w: str) -> str:
    return re.sub(r"\d+", "0", w.lower())[:16]


UNSPACED = re.compile("[\u0e00-\u0eff\u1780-\u17ff\u1000-\u109f]")


def _unspaced(c: str) -> bool:
    """Scripts that put spaces between phrases and have no full stop: Thai, Lao, Khmer, Myanmar."""
    return UNSPACED.match(c) is not None


def _mostly_unspaced(text: str, a: int, b: int) -> bool:
    return UNSPACED.search(text, a, b) is not None and len(UNSPACED.findall(text, a, b)) * 4 > b - a


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """Spans between blank lines, without surrounding white space."""
    pos = 0
    for m in re.finditer(r"\n[^\S\n]*(?:\n[^\S\n]*)*\n|\Z", text.replace("\r\n", " \n").replace("\r", "\n")):
        a, b = pos, m.start()
        pos = m.end()
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            yield a, b


def pieces(text: str, a: int, b: int) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whole) of a block: whole lines (headings, list items) and paragraphs to be cut."""
    lines, at = [], a
    for raw in text[a:b].split("\n"):
        lines.append((at, at + len(raw)))
        at += len(raw) + 1
    kinds, prev = [], ""
    for i, (s, e) in enumerate(lines):
        line = text[s:e].rstrip()
        before = text[lines[i - 1][0] : lines[i - 1][1]].rstrip() if i else ""
        if HASH.match(line):
            kind = "head"
        elif (i == 0 and LIST.match(line) and (BULLET.match(line) or not _prose(line))) or (i and prev == "list" and LIST.match(line)) or (i and before.endswith((":", "：")) and LIST.match(line)):
            kind = "list"
        elif i == 0 and len(lines) > 1 and not ENDED.search(line) and len(line) < 80 and _capitals(line):
            kind = "head"
        elif prev == "list" and line[:1].isspace():
            kind = "more"
        elif prev == "list" and not ENDED.search(before) and line.lstrip()[:1].islower():
            kind = "more"
        else:
            kind = "para"
        kinds.append(kind)
        prev = "list" if kind == "more" else kind
    i = 0
    while i < len(lines):
        j = i + 1
        if kinds[i] == "list":
            while j < len(lines) and kinds[j] == "more":
                j += 1
        elif kinds[i] == "para":
            while j < len(lines) and kinds[j] == "para":
                j += 1
        yield lines[i][0], lines[j - 1][1], kinds[i] != "para"
        i = j


def _capitals(line: str) -> bool:
    letters = [c for c in line if c.isalpha()]
    return bool(letters) and all(c.isupper() for c in letters)


def _prose(line: str) -> bool:
    """A numbered first line that reads as prose: it holds a sentence end inside, or ends in a stop."""
    rest = LIST.sub("", line, count=1)
    return bool(re.search(r"[.!?।。]\s+\S", rest)) or (bool(re.search(r"[.!?।。！？]$", rest)) and len(rest) > 90)


TOKEN = re.compile(r"\S+")
GLUED = re.compile(r"[\"“«(]?(?:[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ']*|[А-ЯЁ][а-яё]*)(?=\s)")  # a word with a capital right after a mark


def candidates(text: str, a: int, b: int) -> list[tuple[int, int, str, str, str]]:
    """(end, next start, mark, word before, word after) for each place in the paragraph where a unit might end."""
    out = []
    thai = _mostly_unspaced(text, a, b)
    depth_french = 0
    straight = 0
    last = a
    for m in MARK.finditer(text, a, b):
        seg = text[last : m.end()]
        straight += seg.count('"')
        depth_french += seg.count("«") - seg.count("»")
        last = m.end()
        e = m.end()
        while e < b:
            c = text[e]
            if c in CLOSE or c in "'’" or (c == "“" and "„" in text[a:e]) or (c == '"' and straight % 2):
                if c == '"':
                    straight += 1
                    last = e + 1
                elif c == "»":
                    depth_french -= 1
                    last = e + 1
                e += 1
            elif c in "   \n" and depth_french > 0 and text[e : e + 2].strip() == "»":
                depth_french -= 1
                e += 2
                last = e
            else:
                break
        mark = m.group()
        strong = any(c in STRONG for c in mark)
        glued = e < b and not text[e].isspace() and not strong
        if glued and not (GLUED.match(text, e) and (text[m.start() - 1 : m.start()].islower() or e > m.end() or text[m.start() - 1 : m.start()].isalnum() and len(mark) == 1)):
            continue
        n = e
        while n < b and text[n].isspace():
            n += 1
        k = m.start()
        while k > a and text[k - 1].isspace():
            k -= 1
        p = k
        while p > a and not text[p - 1].isspace():
            p -= 1
        w = TOKEN.match(text, n, b)
        out.append((e, n, mark if not (e > m.end()) else mark + ")", text[p:k], w.group() if w else ""))
    if thai:
        have = {x[0] for x in out}
        for m in re.finditer(r"\s+", text[a:b]):
            e, n = a + m.start(), a + m.end()
            if e in have or e == a or n >= b:
                continue
            w = TOKEN.match(text, n, b)
            out.append((e, n, " ", _phrase(text, a, e), w.group() if w else ""))
        out.sort()
    return [x for x in out if x[0] < b]


def _phrase(text: str, a: int, e: int) -> str:
    """The word ending at ``e``; in unspaced scripts with the words back to the last one in that script."""
    p = e
    while p > a and not text[p - 1].isspace():
        p -= 1
    for _ in range(4):
        if p <= a or UNSPACED.search(text, p, e):
            break
        q = p
        while q > a and text[q - 1].isspace():
            q -= 1
        p = q
        while p > a and not text[p - 1].isspace():
            p -= 1
    return text[p:e]


def _open_key(w: str) -> str:
    if w and _unspaced(w[0]):
        return "t" + w[:12]
    return _norm(w.lstrip("\"'“„«‹¿¡([{「『（").rstrip(".,;:!?\"'”’»)]}।。"))


def _close_key(w: str) -> str:
    if w and UNSPACED.search(w):
        tail = re.search(r"\S*[\u0e00-\u109f\u1780-\u17ff](?=[^\u0e00-\u109f\u1780-\u17ff]*$)", w).group()
        return "t" + tail[-10:] + ("" if _unspaced(w[-1]) else " #")
    return _norm(w.lstrip("\"'“„«([{「『（").rstrip("\"'”’»)]}"))


def edge_counts(texts: pd.Series) -> Counter:
    """(slot, at an edge) -> occurrences over one batch of texts."""
    c: Counter = Counter()
    for t in texts:
        if not t:
            continue
        for a, b in blocks(t):
            for s, e, whole in pieces(t, a, b):
                if whole:
                    continue
                cs = candidates(t, s, e)
                if not cs and not ENDED.search(t[s:e]) and not (e - s > 20 and _unspaced(t[s])):
                    continue  # a heading
                first = TOKEN.match(t, s, e)
                c[_slot("o", _open_key(first.group())), 1] += 1
                tail = re.search(r"(\S*?)\s*([.!?؟…。！？।]*)[\"'”’»)\]」』）\s]*$", t[s:e][-60:])
                last = _phrase(t, s, s + len(t[s:e].rstrip())) if _mostly_unspaced(t, s, e) else tail.group(1)
                c[_slot("c" + ("" if tail.group(2) else " "), _close_key(last)), 1] += 1
                for _, _, mark, before, after in cs:
                    c[_slot("o", _open_key(after)), 0] += 1
                    c[_slot("c" + (" " if mark == " " else ""), _close_key(before)), 0] += 1
    return c


class Model:
    """Hashed counts of edges (yes) and of other places (no), as log-likelihood ratios."""

    RATE, NOISE = 0.25, 0.004

    def __init__(self, yes: np.ndarray, no: np.ndarray):
        self.llr = yes * np.log(self.RATE / self.NOISE) + no * np.log((1 - self.RATE) / (1 - self.NOISE))

    def opening(self, w: str) -> float:
        k = _open_key(w)
        low = -2.0 if k[:1] == "0" else -4.0
        return float(min(3.0, max(low, self.llr[_slot("o", k)])))

    def closing(self, w: str, spaced: bool) -> float:
        return float(min(3.0, max(-4.0, self.llr[_slot("c" + (" " if spaced else ""), _close_key(w))])))


def boundary(mark: str, before: str, after: str, gap: str, model: Model) -> float:
    """Log-odds of a sentence end here, from its mark, the closing word and the opening word."""
    if mark == " ":
        return model.opening(after) + model.closing(before, True) - 1.5 + (1.0 if len(gap) > 1 and "\n" not in gap else 0)
    first = after.lstrip("\"'“„«‹¿¡([{「『（ ")[:1]
    quoted = mark.endswith(")")
    core = mark.rstrip(")")
    if any(c in STRONG for c in core):
        if quoted:  # after a closing quotation: the sentence goes on unless something opens
            if not gap:
                return -3.0 if (first.isalpha() or after[:1] in "，、,;；") else 3.0
            return 1.0 + model.opening(after) if after else 6.0
        return -6.0 if after[:1] in "，、,;；" else 6.0
    if after[:1] in ",;:)]}»”" or (after[:1] in "-–—" and len(after) == 1):
        return -6.0
    cased = first.lower() != first.upper()
    lower = cased and first == first.lower()
    if core in ("...", "…", "……", ".."):
        return -5.0 if lower or not gap else 2.0 + 0.5 * model.opening(after)
    if any(c in "!?؟" for c in core):
        if lower and not (CODEISH.search(after) and not quoted):
            return -5.0
        if quoted and not cased and first.isalpha():
            return -0.5 + 1.5 * model.opening(after)
        return 5.0 + 0.5 * min(0.0, model.opening(after))
    word = re.sub(r"^[\"'“„«(\[]+|[\"'”’»)\]]+$", "", before)
    key = word.lower().rstrip(".")
    key = key.split("'")[-1].split("’")[-1]
    if quoted:
        if lower and not CODEISH.search(after):
            return -4.0
        return 4.0 + 0.5 * min(0.0, model.opening(after))
    if key in NEVER:
        return -7.0
    if key in MAYBE or re.fullmatch(r"(?:\w\.)+\w", word):
        return -5.0 if lower or first.isdigit() else 2.5 + 0.75 * model.opening(after)
    if len(word) == 1 and word.isalpha():
        known = model.closing(before, False)
        return (-5.0 if lower or first.isdigit() else -2.0 + 0.5 * (model.opening(after) + known)) if known < 2.5 else (-3.0 if lower else 1.0 + model.opening(after))
    if not gap:  # no space after the stop: both words must be known at edges
        return -1.5 + min(2.0, model.closing(before, False)) + min(2.5, model.opening(after)) - (6.0 if "." in before else 0.0)
    known = model.closing(before, False)
    score = 3.0 + (known if len(word) <= 6 or "." in word else max(-1.0, known))  # long words are hardly abbreviations
    if re.fullmatch(r"\d{1,3}", word):
        score = 2.0 + model.opening(after)
        return score - 3.0 if lower else score
    if lower:
        score += -1.0 if CODEISH.search(after) else -3.0 + min(1.5, 0.5 * model.opening(after))
    elif first.isdigit():
        score += 0.5 * model.opening(after)
    else:
        score += 0.5 * min(0.0, model.opening(after)) + 1.0
    return score


def _apart(c: tuple[int, int], d: tuple[int, int]) -> int:
    return abs(c[0] - d[0]) + (c[1] != d[1])


def lattice(text: str, a: int, b: int, cs: list, model: Model) -> tuple[list, list, list[int], list[int], list[float]]:
    """Of a paragraph's candidates: nesting at the ends, nesting at the starts, starts, ends, and the ends' odds."""
    # nesting at every candidate
    depth, stack = [], []
    pos = a
    straight = 0
    for e, *_ in [*cs, (b, b, "", "", "")]:
        for c in NEST.findall(text, pos, e):
            if c == '"':
                straight ^= 1
            elif c == "“" and stack and stack[-1] == "„":
                stack.pop()
            elif c in OPEN:
                stack.append(c)
            elif c in CLOSE:
                if stack and (PAIR.get(stack[-1]) == c):
                    stack.pop()
                elif c in ")”" and stack and any(PAIR.get(x) == c for x in stack):
                    while stack and PAIR.get(stack.pop()) != c:
                        pass
        pos = e
        depth.append((len(stack), straight))
    starts = [a] + [n for _, n, *_ in cs]
    nest = [(0, 0)] + depth[:-1]
    ends = [e for e, *_ in cs] + [b]
    odds = [boundary(mark, before, after, text[e:n], model) for e, n, mark, before, after in cs] + [0.0]
    return depth, nest, starts, ends, odds


def cut(text: str, a: int, b: int, model: Model) -> list[tuple[int, int]]:
    """The best sequence of spans of a paragraph; every start is weighed for every end, by bounds that lose none."""
    cs = candidates(text, a, b)
    if not cs:
        return [(a, b)]
    depth, nest, starts, ends, odds = lattice(text, a, b, cs, model)
    n = len(ends)
    best = [0.0] + [-1e18] * n
    back = [0] * (n + 1)
    # places to start from, by nesting: those at most LONG before the end keep their value (a queue of falling values),
    # those further away lose SLOPE a character, so that the best of them stays the best; of equals the latest wins
    queues: dict[tuple[int, int], deque] = {}
    far: dict[tuple[int, int], tuple[float, int]] = {}
    ready, deepest, highest = 0, 0, -1e18
    for j in range(1, n + 1):
        o, dj, ej = odds[j - 1], depth[j - 1], ends[j - 1]
        while ready < j and ej - starts[ready] >= 3:
            q = queues.setdefault(nest[ready], deque())
            while q and q[-1][0] <= best[ready]:  # an earlier start that is no better never wins again
                q.pop()
            q.append((best[ready], ready))
            highest, deepest = max(highest, best[ready]), max(deepest, nest[ready][0])
            ready += 1
        top, arg = -1e18, j - 1
        for i in range(j - 1, ready - 1, -1):  # spans of one or two characters
            s = best[i] + o - 3.0 - NESTED * _apart(nest[i], dj)
            if s > top:
                top, arg = s, i
        for off in range(max(deepest, dj[0]) + 2):  # nestings by their distance; none further away can win once this one cannot
            if highest + o - NESTED * off < top or (off > dj[0] + 1 and dj[0] + off - 1 > deepest):
                break
            near = [(dj[0] - off, dj[1]), (dj[0] + off, dj[1]), (dj[0] - off + 1, 1 - dj[1]), (dj[0] + off - 1, 1 - dj[1])]
            for c in dict.fromkeys(near[: 2 if off == 0 else 4]):
                q = queues.get(c)
                if q is None:
                    continue
                while q and ej - starts[q[0][1]] > LONG:
                    value, i = q.popleft()
                    value += SLOPE * starts[i]
                    if c not in far or (value, i) >= far[c]:
                        far[c] = (value, i)
                cost = NESTED * off
                for value, i in ([q[0]] if q else []) + ([(far[c][0] - SLOPE * (ej - LONG), far[c][1])] if c in far else []):
                    s = value + o - cost
                    if s > top or (s == top and i > arg):
                        top, arg = s, i
        best[j], back[j] = top, arg
    out, j = [], n
    while j:
        i = back[j]
        out.append((starts[i], ends[j - 1]))
        j = i
    return out[::-1]


def units(text: str | None, model: Model) -> list[tuple[int, int]]:
    """All sentence units of a text."""
    out = []
    for a, b in blocks(text or ""):
        for s, e, whole in pieces(text, a, b):
            while s < e and text[s].isspace():
                s += 1
            while e > s and text[e - 1].isspace():
                e -= 1
            if s < e:
                out += [(s, e)] if whole else cut(text, s, e, model)
    fixed = []
    for s, e in out:
        while s < e and text[s].isspace():
            s += 1
        while e > s and text[e - 1].isspace():
            e -= 1
        if s < e:
            fixed.append((s, e))
    return fixed


def train(docs: DataFrame, text: str = "text") -> Model:
    """Edge statistics over all documents; SLOTS pairs of counts reach the driver, whatever the data."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            c = edge_counts(pdf[text])
            yield pd.DataFrame([(k[0], k[1], n) for k, n in c.items()], columns=["slot", "edge", "n"])

    got = docs.select(text).mapInPandas(count, "slot int, edge int, n long").groupBy("slot", "edge").agg(F.sum("n").alias("n")).toPandas()
    tables = np.zeros((2, SLOTS))
    tables[got["edge"].to_numpy(int), got["slot"].to_numpy(int)] = got["n"].to_numpy(float)
    return Model(tables[1], tables[0])


def sentences(docs: DataFrame, id_col: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """(id, start_char, end_char), one row per unit."""
    model = model or train(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast(model.llr)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model.__new__(Model)
        m.llr = shared.value
        for pdf in batches:
            rows = [(i, s, e) for i, t in zip(pdf[id_col], pdf[text], strict=True) for s, e in units(t, m)]
            yield pd.DataFrame(rows, columns=[id_col, "start_char", "end_char"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text).where(F.col(text).isNotNull()).mapInPandas(run, f"{id_col} {kind}, start_char int, end_char int")
