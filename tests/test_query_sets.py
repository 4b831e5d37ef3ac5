"""Search operators over every block whose id is divisible by 100, or every identifier, against all rows."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import search as se
from lodestrata.plans import documents as pd_
from lodestrata.plans import search as ps


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(4)
    ids = [100 * k for k in range(1, 9)] + rng.sample([i for i in range(1, 900) if i % 100], 50)
    words = ["valve", "signal", "torque", "encoder", "battery", "record", "status", "relay", *(f"rare{k}" for k in range(30)), *(f"K{k}" for k in range(12))]
    text = {i: " ".join(rng.choice(words) for _ in range(rng.randint(2, 9))) for i in ids}
    text[800] = text[700].split()[0]
    d = tmp_path_factory.mktemp("sets")
    spark.createDataFrame([(i, i % 7, rng.choice(["text", "heading", "table"]), text[i]) for i in ids], "block_id long, doc_id long, kind string, text string").write.parquet(f"{d}/blocks.parquet")
    return str(d), text


def _keys(text):
    return {i: {w.upper() for w in re.findall(r"(?:K|rare)\d+", t)} for i, t in text.items()}


def test_shared_identifiers(spark, corpus):
    d, text = corpus
    keys = _keys(text)
    spread = Counter(k for ks in keys.values() for k in ks)
    want = {(q, b, round(sum(1 / math.log(1 + spread[k]) for k in keys[q] & keys[b]), 4), len(keys[q] & keys[b])) for q in keys if q % 100 == 0 for b in keys if b != q and keys[q] & keys[b]}
    got = {(r["query_id"], r["block_id"], round(r["weight"], 4), r["n_shared"]) for r in pd_.shared_identifiers(spark, d).collect()}
    assert len({q for q, *_ in want}) > 2 and got == want


def test_ident_cooccurrence(spark, corpus):
    d, text = corpus
    keys = _keys(text)
    n = Counter((a, b) for ks in keys.values() for a in ks for b in ks if a != b)
    want = {(a, b): k for a in {a for a, _ in n} for b, k in sorted(((b, k) for (x, b), k in n.items() if x == a), key=lambda t: (-t[1], t[0]))[:15]}
    got = {(r["key"], r["other"]): r["n"] for r in pd_.ident_cooccurrence(spark, d).collect()}
    assert got == want and len({a for a, _ in n}) > 10


def test_more_like_this(spark, corpus):
    d, text = corpus
    terms = {i: set(t.lower().split()) for i, t in text.items()}
    df = Counter(t for ts in terms.values() for t in ts)
    want = set()
    for q in terms:
        if q % 100 == 0:
            w = set(sorted((t for t in terms[q] if df[t] * 5 < len(terms)), key=lambda t: (-len(t), t))[:16])
            best = sorted(((q, b, len(w & terms[b])) for b in terms if b != q and len(w & terms[b]) >= 2), key=lambda t: (-t[2], t[1]))
            want |= set(best[:15])
    assert len({q for q, *_ in want}) > 2
    assert {(r["query_id"], r["block_id"], r["shared"]) for r in ps.more_like_this(spark, d).collect()} == want


def test_search_batch(spark, corpus):
    d, text = corpus
    terms = {i: set(t.lower().split()) for i, t in text.items()}
    want = {q: sum(terms[q] <= ts for ts in terms.values()) for q in terms if q % 100 == 0}
    got = {r["qid"]: r["n_matches"] for r in ps.search_batch(spark, d).collect()}
    assert got == want and len(want) == 8 and max(want.values()) > 1


@pytest.fixture
def small_blocks(monkeypatch):
    """Many blocks of rows, several parts of queries, and words kept as bits and as lists."""
    for name, n in (("QUERIES", 3), ("ROWS", 16), ("POSTINGS", 60), ("DENSE", 3)):
        monkeypatch.setattr(se, name, n)


def _exchanges_results_only(df):
    """No shuffle holds a pair of a query and a row: what is exchanged after the rows are read are a task's results."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "MapInArrow" in plan and "Join" not in plan and "Generate" not in plan


def test_more_like_this_in_blocks(spark, corpus, small_blocks):
    test_more_like_this(spark, corpus)
    assert _exchanges_results_only(ps.more_like_this(spark, corpus[0]))


@pytest.fixture
def sets(spark):
    """Rows, queries that are mostly ids of rows, and their words."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(12)]
    ts = {i: rng.choices(words, k=rng.randrange(0, 9)) for i in rng.sample(range(2000), 400)}
    rows = spark.createDataFrame([(i, t, 1.0) for i, t in ts.items()], "id long, ts array<string>, w double").repartition(3)
    qs = {q: sorted(set(rng.choices(words, k=5))) for q in [*rng.sample(sorted(ts), 9), 5000]}
    return rows, spark.createDataFrame([(q, t) for q, w in qs.items() for t in w], "qid long, term string"), ts, qs


def test_sharing_most(spark, sets, small_blocks):
    rows, queries, ts, qs = sets
    want = {(q, i, n) for q, w in qs.items() for i, n in sorted(((i, len(set(w) & set(t))) for i, t in ts.items() if i != q and len(set(w) & set(t)) >= 2), key=lambda x: (-x[1], x[0]))[:4]}
    got = se.sharing_most(rows, queries.join(se.frequencies(rows), "term"), 4, least=2).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert se.sharing_most(rows, queries.where("false").withColumn("df", F.lit(1)), 4).count() == 0


def test_search_batch_in_blocks(spark, corpus, small_blocks):
    test_search_batch(spark, corpus)
    assert _exchanges_results_only(ps.search_batch(spark, corpus[0]))


def test_holding_all(spark, sets, small_blocks):
    rows, queries, ts, qs = sets
    queries = queries.union(spark.createDataFrame([(5001, "w1"), (5001, "nowhere")], "qid long, term string"))
    n = {q: sum(set(w) <= set(t) for t in ts.values()) for q, w in qs.items()}
    ix = se.build_index(rows.select("id", F.array_join("ts", " ").alias("text")), "id", "text")
    score = {r["qid"]: round(r["best"], 9) for r in se.bm25(ix, queries).groupBy("qid").agg(F.max("score").alias("best")).collect()}
    got = {r["qid"]: (r["n"], round(r["best"], 9)) for r in se.holding_all(rows, queries).collect()}
    assert got == {q: (k, score[q]) for q, k in n.items() if k} and len(got) > 2
