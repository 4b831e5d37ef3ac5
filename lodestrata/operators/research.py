"""Meaning by an injected embedder, sentence alignment, glossaries, signatures, examples, renames and links."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Stages

DIM = 256


def hashed_bag(texts: list[str | None]) -> np.ndarray:
    """The default embedder: words hashed into 256 signed counts, unit length. Empty texts give zeros."""
    out = np.zeros((len(texts), DIM), np.float32)
    for i, t in enumerate(texts):
        for w in re.findall(r"[^\W_]+", (t or "").lower()):
            h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
            out[i, h % DIM] += 1 if h >> 31 else -1
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(n == 0, 1, n)


def embed(df: DataFrame, text: str, out: str = "vector", embedder: Callable = hashed_bag) -> DataFrame:
    """Vectors of a text column, batch by batch; ``embedder`` takes a list of texts and gives a matrix."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(list(embedder(s.tolist())))

    return df.withColumn(out, run(F.col(text)))


def usable(c: str, dim: int) -> Column:
    """A vector of ``dim`` finite values that are not all zero."""
    v = F.col(c)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > F.lit(3.4028235e38)))
    return v.isNotNull() & (F.size(v) == dim) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


BLOCK = 4_096  # vectors, or queries, of one block


def similarities(rows: DataFrame, queries: DataFrame, k: int | None = None, cosine: bool = False, itself: bool = False) -> DataFrame:
    """(qid, id, sim, and the other columns of both) of every query (qid, qv, ...) with every row (id, v, ...), without a
    row of the query's own id unless ``itself``.

    Queries and rows are cut into blocks by hash; each pair of blocks is one matrix product in one task, which keeps the best
    ``k`` rows of each query, all of them for None. Similarities are rounded to nine places.
    """
    n = rows.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    m = queries.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    nr, nq = max(1, -(-n // BLOCK)), max(1, -(-m // BLOCK))
    left = [c for c in rows.columns if c not in ("id", "v")]
    right = [c for c in queries.columns if c not in ("qid", "qv")]
    kinds = dict(rows.dtypes) | dict(queries.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("qid", "id")) + ", sim double" + "".join(f", {c} {kinds[c]}" for c in left + right)

    def product(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({c: [] for c in ["qid", "id", "sim", *left, *right]})
        x, y = np.stack(a["v"].to_numpy()).astype(np.float64), np.stack(b["qv"].to_numpy()).astype(np.float64)
        if cosine:
            x, y = (z / np.linalg.norm(z, axis=1, keepdims=True) for z in (x, y))
        s = np.round(y @ x.T, 9)
        if not itself:
            s[b["qid"].to_numpy()[:, None] == a["id"].to_numpy()[None, :]] = -np.inf
        if k is None or k >= len(a):
            at = np.broadcast_to(np.arange(len(a)), s.shape)
        else:  # the k best, ties by the smaller id
            at = np.lexsort((np.broadcast_to(a["id"].to_numpy(), s.shape), -s), axis=1)[:, :k]
        i, j = np.repeat(np.arange(len(b)), at.shape[1]), at.ravel()
        keep = np.isfinite(s[i, j])
        i, j = i[keep], j[keep]
        out = {"qid": b["qid"].to_numpy()[i], "id": a["id"].to_numpy()[j], "sim": s[i, j]}
        return pd.DataFrame(out | {c: a[c].to_numpy()[j] for c in left} | {c: b[c].to_numpy()[i] for c in right})

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = rows.withColumn("rb", F.pmod(F.xxhash64("id"), F.lit(nr)).cast("int")).withColumn("qb", every(nq))
    b = queries.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(nq)).cast("int")).withColumn("rb", every(nr))
    return a.groupBy("rb", "qb").cogroup(b.groupBy("rb", "qb")).applyInPandas(product, schema)


def nearest(df: DataFrame, id_col: str, queries: dict[int, np.ndarray], k: int = 100, floor: float = 0.78, band: float = 0.05) -> DataFrame:
    """(qid, id, sim): rows near given query vectors: above a floor and within a band below the best, k at most. The few
    queries travel with the task; every batch keeps its own best k before anything is shuffled."""
    qs = sorted(queries)
    m = np.stack([queries[q] for q in qs]).astype(np.float32) if qs else np.zeros((0, DIM), np.float32)

    def run(batches):
        for pdf in batches:
            rows = []
            if len(pdf) and len(qs):
                s = m @ np.stack(pdf["vector"].to_numpy()).astype(np.float32).T
                for i, q in enumerate(qs):
                    at = np.flatnonzero(s[i] >= floor)
                    at = at[np.argsort(-s[i, at], kind="stable")[:k]]
                    rows += [(q, int(pdf[id_col].iloc[j]), float(s[i, j])) for j in at]
            yield pd.DataFrame(rows, columns=["qid", "id", "sim"])

    x = df.select(id_col, "vector").where("vector is not null").mapInPandas(run, "qid int, id long, sim double")
    x = x.withColumn("top", F.max("sim").over(Window.partitionBy("qid"))).where(F.col("sim") >= F.col("top") - band).drop("top")
    w = Window.partitionBy("qid").orderBy(F.desc("sim"), "id")
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def sentences(text: str | None, least: int = 6) -> list[str]:
    """Sentences of at least ``least`` words; the whole text if there is none."""
    parts = [p.strip() for p in re.split(r"(?<=[.!?;])\s+(?=[A-Z0-9\"(])", text or "") if len(p.split()) >= least]
    return parts or [text or ""]


def align(focus: str, other: str, embedder: Callable = hashed_bag, least: float = 0.0) -> list[tuple[str, str, float]]:
    """For each sentence of one text its nearest sentence in another."""
    a, b = sentences(focus), sentences(other)
    s = embedder(a) @ embedder(b).T
    return [(x, b[j], float(s[i, j])) for i, x in enumerate(a) for j in [int(s[i].argmax())] if s[i, j] >= least]


def definitions(blocks: DataFrame) -> DataFrame:
    """(doc_id, term, definition): sentences of the form "Term" means ...; a document's first one wins."""
    pat = r'"([^"]{2,40})" means ([^.]+\.)'
    x = blocks.select("doc_id", "seq", "block_id", F.explode(F.regexp_extract_all("text", F.lit(pat), F.lit(0))).alias("m"))
    y = x.select("doc_id", "seq", "block_id", F.regexp_extract("m", pat, 1).alias("term"), F.regexp_extract("m", pat, 2).alias("definition"))
    return y.groupBy("doc_id", "term").agg(F.min_by("definition", F.struct("seq", "block_id", "definition")).alias("definition"))


def split_types(text: str) -> list[str]:
    """Parts of a list of types at top-level commas: generics, arrays, objects and functions stay whole."""
    out, depth, cur = [], 0, ""
    for i, c in enumerate(text):
        if c in "<([{":
            depth += 1
        elif c in ")]}" or (c == ">" and text[i - 1 : i] not in ("=", "-")):
            depth -= 1
        if c == "," and depth == 0:
            out.append(cur.strip())
            cur = ""
        else:
            cur += c
    return out + [cur.strip()] if cur.strip() else out


def parameter_types(signature: str | None) -> list[str]:
    """Types of a signature's parameters, Java (Type name) or TypeScript (name: Type); untyped ones are ''."""
    m = re.search(r"\((.*)\)", signature or "", re.S)
    if not m:
        return []
    body, depth, end = signature[m.start() + 1 :], 1, 0
    for end, c in enumerate(body):
        depth += (c == "(") - (c == ")")
        if not depth:
            break
    out = []
    for p in split_types(body[:end]):
        p = re.sub(r"@\w+(?:\([^)]*\))?\s*|\b(?:final|public|private|protected|readonly)\s+", "", p)
        p = re.split(r"=(?!>)", p)[0].strip()
        if re.match(r"^(?:\.\.\.)?[\w$]+\??\s*:", p):
            out.append(p.split(":", 1)[1].strip())
        else:
            ws = p.rsplit(None, 1)
            out.append(ws[0].strip() if len(ws) == 2 else "")
    return out


def parameter_types_of(c: Column | str) -> Column:
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(parameter_types)

    return run(F.col(c) if isinstance(c, str) else c)


def lcs_share(a: str, b: str) -> float:
    """Length of the longest common subsequence over the longer length; of two empty strings 1."""
    if not a and not b:
        return 1.0
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1] / max(len(a), len(b))


# fixed values: weights of an example's features
WEIGHTS = {"type": 0.30, "member": 0.25, "context": 0.20, "structure": 0.15, "quality": 0.10}


def example_score(c: dict[str, Column]) -> Column:
    """Weighted sum of an example's five features."""
    total = F.lit(0.0)
    for k, w in WEIGHTS.items():
        total = total + w * c[k]
    return total


def quality(lines: Column, linked: Column, strings: Column) -> Column:
    """1, 0.7 or 0.4 by length, less 0.3 if unlinked and 0.2 if mostly strings, within 0 and 1."""
    base = F.when(lines <= 3, 1.0).when(lines <= 6, 0.7).otherwise(0.4)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base - F.when(linked, 0.0).otherwise(0.3) - F.when(strings, 0.2).otherwise(0.0)))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of an undirected graph: the smallest id, spread along edges and shortened by jumping."""
    st = Stages(edges.sparkSession, "components")
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    e = st.put(e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    lab = st.put(e.select(F.col("x").alias("node")).distinct().withColumn("component", F.col("node")))
    while True:
        near = e.join(lab.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("component").alias("m"))
        step = lab.join(near, lab["node"] == near["x"], "left").select("node", F.least("component", F.coalesce("m", "component")).alias("c"), F.col("component").alias("old"))
        jump = lab.select(F.col("node").alias("j"), F.col("component").alias("jc"))
        nxt = st.put(step.join(jump, step["c"] == jump["j"], "left").select("node", F.least("c", F.coalesce("jc", "c")).alias("component"), "old"))
        if not nxt.where("component <> old").limit(1).count():
            return nxt.select("node", "component")
        lab = nxt.select("node", "component")


def agrees(found: dict[str, Column], expected: dict[str, Column]) -> Column:
    """Every expectation that is given must hold: document and text by substring, clause and page by equality."""
    out = F.lit(True)
    for k, e in expected.items():
        f = found[k]
        hit = F.contains(F.lower(f), F.lower(e)) if k in ("document", "text") else f == e
        out = out & F.coalesce(hit, e.isNull() | (e == ""))
    return out


def link_state(links: DataFrame, targets: DataFrame) -> DataFrame:
    """(link_id, state): ok, wrong, dead, unresolved or external. links: link_id, kind, doc_id, target_page, expected_label,
    dead; targets: doc_id, label, page."""
    t = targets.groupBy(F.col("doc_id").alias("t_doc"), F.lower("label").alias("t_label")).agg(F.min("page").alias("t_page"))
    j = links.join(t, (F.col("doc_id") == F.col("t_doc")) & (F.lower("expected_label") == F.col("t_label")), "left")
    s = F.when(F.col("kind") == "uri", "external").when(F.col("dead"), "dead").when(F.col("t_page").isNull(), "unresolved").when(F.col("t_page") == F.col("target_page"), "ok").otherwise("wrong")
    return j.select("link_id", s.alias("state"))


def match_outline(toc: DataFrame, headings: DataFrame) -> DataFrame:
    """(doc_id, entry, block_id, how): bookmarks matched to headings by text, else by number. toc: doc_id, entry, text,
    num; headings: doc_id, block_id, text, num."""
    norm = lambda c: F.trim(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " ")))
    first = lambda k: headings.groupBy(F.col("doc_id").alias("d"), k.alias("k")).agg(F.min("block_id").alias("b"))
    t, n = first(norm(F.col("text"))), first(F.col("num"))
    x = toc.join(t, (F.col("doc_id") == F.col("d")) & (norm(F.col("text")) == F.col("k")), "left").select("doc_id", "entry", "num", F.col("b").alias("by_text"))
    y = x.join(n, (F.col("doc_id") == F.col("d")) & (F.col("num") == F.col("k")) & (F.col("num") != ""), "left")
    return y.select("doc_id", "entry", F.coalesce("by_text", "b").alias("block_id"), F.when(F.col("by_text").isNotNull(), "text").when(F.col("b").isNotNull(), "number").otherwise("none").alias("how"))
