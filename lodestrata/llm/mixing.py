"""Mixing sources to target shares of tokens, by entropy balancing.

Each document i of source s gets a rate w_i in (0, cap_s), as close as possible in relative entropy to one common rate,
under one token constraint per source: sum of w_i t_i = share_s * T. The convex dual has one multiplier per source; its
optimum is an exponential tilt w_i = cap_s * sigmoid(a_s + l_s t_i / mean_s), found by Newton steps whose gradients and
Hessians are sums over all documents, computed in Spark. Rates are rounded to whole copies with a per-document hash
as the random draw, and one offset per source, read from a histogram of fixed size, that makes the tokens add up.

T is the most that every source with documents can reach within its cap. A target source without documents cannot
contribute: its share is reported as 0, the others keep their proportions. Sources not in the targets are left out.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Stages

BINS = 4096
CHUNK = 20_000  # characters encoded at once; longer texts are cut at white space


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """``docs`` with ``tokens``: tokens of the text in a public vocabulary, a file that every worker can read together with
    its splitting pattern; null texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(tokenizer)
        for pdf in batches:
            yield pdf.drop(columns=[text]).assign(tokens=[_count(enc, t) for t in pdf[text]])

    rest = [f for f in docs.schema.fields if f.name != text]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + ["tokens long"])
    return docs.mapInPandas(run, schema)


def _encoder(path: str):
    import tiktoken

    import public_tokenizers  # the vocabulary's own splitting pattern; another one would change every count

    pattern = public_tokenizers.PATTERN
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _count(enc, text) -> int:
    if not isinstance(text, str) or not text:
        return 0
    n, at = 0, 0
    while at < len(text):
        end = min(len(text), at + CHUNK)
        if end < len(text):
            cut = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
            end = cut if cut > at else end
        n += len(enc.encode_ordinary(text[at:end]))
        at = end
    return n


def _rates(df: DataFrame, a: dict, lam: dict) -> DataFrame:
    """Adds the tilted rate ``w`` from the sources' multipliers (one row per target source, which are few)."""
    spark = df.sparkSession
    par = spark.createDataFrame([(s, float(a[s]), float(lam[s])) for s in a], "p_source string, a double, lam double")
    x = df.join(F.broadcast(par), F.col("source") == F.col("p_source"))
    return x.withColumn("w", F.col("cap") / (1 + F.exp(-(F.col("a") + F.col("lam") * F.col("z")))))


def mixture(docs: DataFrame, targets: DataFrame, tokenizer: str, id_col: str = "doc_id", steps: int = 40, tolerance: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """(copies, shares). copies: id, source, tokens, rate, copies, for each document of a target source (copies may be
    0). shares: source, target_share, reachable_share, documents, tokens, actual_share.

    Ids are unique: of repeated rows the first by (source, tokens) counts. Null sources and empty texts take no part.
    Target rows that repeat a source count once. Empty inputs give empty copies and shares of 0.
    """
    spark = docs.sparkSession
    st = Stages(spark, "mixing")
    t = targets.where("source is not null and target_share > 0 and max_repeats >= 1").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("cap"))
    goal = {r["source"]: (float(r["target_share"]), int(r["cap"])) for r in t.collect()}
    caps = spark.createDataFrame([(s, c) for s, (_, c) in goal.items()], "c_source string, cap int")
    d = docs.select(F.col(id_col).alias("id"), "source", "text").join(F.broadcast(caps), F.col("source") == F.col("c_source")).drop("c_source")
    d = token_counts(d, tokenizer=tokenizer).where("tokens > 0")
    d = st.put(d.groupBy("id").agg(F.min(F.struct("source", "tokens", "cap")).alias("m")).select("id", "m.*"))
    have = {r["source"]: (int(r["n"]), int(r["tokens"]), int(r["top"])) for r in d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("top")).collect()}
    total_share = sum(goal[s][0] for s in have) or 1.0
    want = {s: goal[s][0] / total_share for s in have}
    size = min((goal[s][1] * have[s][1] / want[s] for s in have), default=0.0)
    need = {s: want[s] * size for s in have}
    mean = {s: have[s][1] / have[s][0] for s in have}
    means = spark.createDataFrame([(s, mean[s]) for s in have], "m_source string, mean double")
    d = d.join(F.broadcast(means), F.col("source") == F.col("m_source")).withColumn("z", F.col("tokens") / F.col("mean")).drop("m_source", "mean")
    # the common rate each source starts from, kept off the cap's edge, where the tilt has no finite optimum
    full = {s for s in have if need[s] >= goal[s][1] * have[s][1] * (1 - 1e-9)}
    lam = dict.fromkeys(have, 0.0)
    base = _base(want, size, have)
    a = {s: float(np.log(min(max(base / goal[s][1], 1e-9), 1 - 1e-9) / (1 - min(max(base / goal[s][1], 1e-9), 1 - 1e-9)))) for s in have}
    lo, hi = {s: -1e6 for s in have}, {s: 1e6 for s in have}
    for _ in range(steps):
        open_ = [s for s in have if s not in full]
        if not open_:
            break
        x = _rates(d, a, lam)
        p = F.col("w") / F.col("cap")
        rows = x.groupBy("source").agg(F.sum(F.col("w") * F.col("z")).alias("g"), F.sum(F.col("w") * (1 - p) * F.col("z") * F.col("z")).alias("h")).collect()
        worst = 0.0
        for r in rows:
            s = r["source"]
            if s in full:
                continue
            gap = need[s] / mean[s] - r["g"]
            worst = max(worst, abs(gap) * mean[s] / max(need[s], 1.0))
            (lo if gap > 0 else hi)[s] = lam[s]
            step = lam[s] + gap / max(r["h"], 1e-12)
            if not lo[s] < step < hi[s]:  # outside the bracket: halve it, or double the reach
                step = (lo[s] + hi[s]) / 2 if lo[s] > -1e6 and hi[s] < 1e6 else lam[s] + np.sign(gap) * max(1.0, abs(lam[s]))
            lam[s] = float(step)
        if worst < tolerance:
            break
    x = _rates(d, a, lam)
    full_col = F.col("source").isin(list(full)) if full else F.lit(False)
    x = x.withColumn("w", F.when(full_col, F.col("cap").cast("double")).otherwise(F.least("w", "cap")))
    # rounding: copies = floor(w + (u + shift) mod 1) keeps every rate; the shift comes from fixed bins of the threshold
    u = (F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1 << 40)) / float(1 << 40)).cast("double")
    x = st.put(x.select("id", "source", "tokens", "cap", F.col("w").alias("rate"), F.floor("w").cast("long").alias("whole"), (F.col("w") - F.floor("w")).alias("part"), u.alias("u")))
    # a document takes its extra copy when u < part + shift; it flips at shift = u - part, binned over [-1, 1)
    flip = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((F.col("u") - F.col("part") + 1) / 2 * BINS))).cast("int")
    may = (F.col("part") > 0) & (F.col("whole") < F.col("cap"))
    fixed = {r["source"]: float(r["f"]) for r in x.groupBy("source").agg(F.sum(F.col("whole") * F.col("tokens")).alias("f")).collect()}
    hist = x.where(may).groupBy("source", flip.alias("bin")).agg(F.sum("tokens").alias("t")).collect()
    shift = dict.fromkeys(have, 0)
    for s in have:
        run, best = fixed.get(s, 0.0), 0
        gap = abs(run - need[s])
        for b, tk in sorted((r["bin"], r["t"]) for r in hist if r["source"] == s):
            run += tk
            if abs(run - need[s]) < gap:
                gap, best = abs(run - need[s]), b + 1
        shift[s] = best
    sh = spark.createDataFrame([(s, b) for s, b in shift.items()], "s_source string, first int")
    x = x.join(F.broadcast(sh), F.col("source") == F.col("s_source"))
    copies = (F.col("whole") + F.when(may & (flip < F.col("first")), 1).otherwise(0)).cast("int")
    out = st.put(x.select(F.col("id").alias(id_col), "source", "tokens", F.round("rate", 9).alias("rate"), copies.alias("copies")))
    got = out.groupBy("source").agg(F.count_if(F.col("copies") > 0).alias("documents"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens"))
    tg = spark.createDataFrame([(s, g[0], want.get(s, 0.0)) for s, g in goal.items()], "t_source string, target_share double, reachable_share double")
    sums = tg.join(got, F.col("t_source") == F.col("source"), "left")
    all_tokens = got.agg(F.sum("tokens").alias("all_tokens"))
    shares = sums.join(F.broadcast(all_tokens), F.lit(True), "left")  # one row
    shares = shares.select(F.col("t_source").alias("source"), "target_share", "reachable_share", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"))
    return out, shares


def _base(want: dict, size: float, have: dict) -> float:
    """The one rate at which all documents together would hold ``size`` tokens."""
    tokens = sum(h[1] for h in have.values())
    return size / tokens if tokens else 0.0
