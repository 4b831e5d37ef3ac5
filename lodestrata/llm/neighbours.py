"""The k most similar vectors of every vector, through learned partitions.

A cell of vectors is cut into parts by a router that is fitted on a bounded sample (``SAMPLE`` rows, by hash): the sample's
exact neighbour graph is cut into balanced parts by size-constrained label propagation, and a small network learns to tell
from a vector which parts its neighbours lie in. *Every* row is routed: it is stored in its most probable part and asks the
most probable parts for its neighbours. All vectors are the first cell; a part that holds more than ``SPLIT`` times
``PART_ROWS`` rows is a cell again with a router of its own, so that parts keep their size however many rows there are.
Candidates are ranked by exact cosine in blocks. Exact copies are searched once and expanded afterwards. Rows stream through
their routers in pieces of ``PIECE`` rows, so that a task's memory does not grow with its cell.

``most`` and ``mass`` bound what is asked; ``most=None`` asks every part of every cell, which is exact.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import Stages

SAMPLE = 16_384  # rows the router is fitted on, at most
PART_ROWS = 1_500  # aimed at per part
FAN = 256  # parts a cell is cut into, at most; larger cells take more levels
SPLIT = 4  # times PART_ROWS from which a part is a cell again
LEVELS = 8  # of cells; FAN**LEVELS parts are more than can be stored
LANE = 50_000  # rows of a cell, stored and asking, that are routed in one run; a task has about as many
PIECE = 16_384  # routed rows that are held at once, at most (or one row's parts)
BLOCK = 4_096  # rows of a part, and queries, in one task's block
GRAPH_K = 10
HIDDEN = 192
PROBES = 12  # parts asked at most
MASS = 0.97  # probability after which no further part is asked


def usable(c: str, dim: int) -> Column:
    """A vector of ``dim`` finite values that are not all zero."""
    v = F.col(c)
    # a null element counts as bad; infinities and NaN leave the finite range
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > F.lit(3.4028235e38)))
    return v.isNotNull() & (F.size(v) == dim) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def knn_graph(x: np.ndarray, k: int, block: int = 256) -> np.ndarray:
    """Exact neighbour lists of unit vectors, without the vector itself."""
    out = np.empty((len(x), k), np.int32)
    for i in range(0, len(x), block):
        s = x[i : i + block] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
        out[i : i + block] = np.argpartition(np.negative(s, out=s), k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1, seed: int = 7) -> np.ndarray:
    """Labels of equal-sized parts that cut few edges of the graph."""
    rng = np.random.default_rng(seed)
    n = len(x)
    cap = math.ceil(slack * n / parts)

    def assign(score: np.ndarray) -> np.ndarray:
        """Each row its best part with room left, surest rows first."""
        lab, room = np.full(n, -1), np.full(parts, cap)
        pref = np.argsort(-score, axis=1)
        sure = np.argsort(-(np.take_along_axis(score, pref[:, :1], 1) - np.take_along_axis(score, pref[:, min(1, parts - 1) :][:, :1], 1))[:, 0])
        for i in sure:
            for p in pref[i]:
                if room[p]:
                    lab[i], room[p] = p, room[p] - 1
                    break
        return lab

    seeds = x[rng.choice(n, parts, replace=False)]
    for _ in range(4):
        lab = assign(x @ seeds.T)
        seeds = np.stack([x[lab == p].mean(0) if (lab == p).any() else x[rng.integers(n)] for p in range(parts)])
        seeds /= np.linalg.norm(seeds, axis=1, keepdims=True) + 1e-9
    src = np.concatenate([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()])
    dst = np.concatenate([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])])
    for _ in range(rounds):
        score = np.zeros((n, parts), np.float32)
        np.add.at(score, (src, lab[dst]), 1.0)
        score[np.arange(n), lab] += 0.5
        score += 0.3 * (x @ seeds.T)
        new = assign(score)
        if (new == lab).mean() > 0.999:
            break
        lab = new
    return lab


class Router:
    """A network with one hidden layer from a vector to the probabilities of the parts."""

    def __init__(self, dim: int, parts: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.w = [rng.normal(0, (2 / dim) ** 0.5, (dim, HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32), rng.normal(0, (1 / HIDDEN) ** 0.5, (HIDDEN, parts)).astype(np.float32), np.zeros(parts, np.float32)]

    @staticmethod
    def of(w: list[np.ndarray]) -> Router:
        net = Router.__new__(Router)
        net.w = w
        return net

    def probs(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.w
        z = np.maximum((x * 8) @ a + b, 0) @ c + d
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 24, batch: int = 512, rate: float = 2e-3) -> Router:
        """Soft targets y (rows of probabilities), Adam."""
        rng, m, v, t = np.random.default_rng(11), [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for ep in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                at = order[i : i + batch]
                xb = x[at] + rng.normal(0, 0.03, (len(at), x.shape[1])).astype(np.float32)
                xb *= 8
                h = np.maximum(xb @ self.w[0] + self.w[1], 0)
                z = h @ self.w[2] + self.w[3]
                z = np.exp(z - z.max(1, keepdims=True))
                g = (z / z.sum(1, keepdims=True) - y[at]) / len(at)
                gh = (g @ self.w[2].T) * (h > 0)
                t += 1
                lr = rate * 0.5 * (1 + math.cos(math.pi * ep / epochs))
                for k, gr in enumerate([xb.T @ gh, gh.sum(0), h.T @ g, g.sum(0)]):
                    m[k] = 0.9 * m[k] + 0.1 * gr
                    v[k] = 0.999 * v[k] + 0.001 * gr * gr
                    self.w[k] -= (lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


def fit_router(x: np.ndarray, parts: int) -> Router | None:
    """Router over ``parts`` parts, from a sample of unit vectors. None where one part is enough."""
    if parts < 2 or len(x) < 4 * GRAPH_K or len(x) < 2 * parts:
        return None
    graph = knn_graph(x, GRAPH_K)
    lab = balanced_parts(x, graph, parts)
    y = np.zeros((len(x), parts), np.float32)
    np.add.at(y, (np.repeat(np.arange(len(x)), GRAPH_K), lab[graph].ravel()), 0.5 / GRAPH_K)
    y[np.arange(len(x)), lab] += 0.5
    return Router(x.shape[1], parts).fit(x, y)


def probes(p: np.ndarray, most: int | None, mass: float) -> tuple[np.ndarray, np.ndarray]:
    """Ranked parts per row and how many of them to ask."""
    if most is None:
        return np.argsort(-p, axis=1), np.full(len(p), p.shape[1])
    most = min(most, p.shape[1])
    top = np.argsort(-p, axis=1)[:, :most]
    cum = np.cumsum(np.take_along_axis(p, top, 1), axis=1)
    return top, 1 + (cum[:, :-1] < mass).sum(1)


def matrix(u: pa.Array) -> np.ndarray:
    """The vectors of a column as rows of a matrix."""
    return u.flatten().to_numpy(zero_copy_only=False).reshape(len(u), -1)


def _batch(vid: np.ndarray, x: np.ndarray, cell: np.ndarray, role: np.ndarray) -> pa.RecordBatch:
    u = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(vid), u, pa.array(cell), pa.array(role)], ["vid", "u", "cell", "role"])


def _routed(b: pa.RecordBatch, net: Router, most: int | None, mass: float) -> Iterator[pa.RecordBatch]:
    """Rows (vid, u, cell, role) in the parts of their cell, a piece at a time: role 0, the stored row, in the most probable
    one; role 1, the query, in all it asks."""
    x = matrix(b["u"])
    vid, cell, role = (b[c].to_numpy() for c in ("vid", "cell", "role"))
    parts = net.w[3].size
    step = max(1, PIECE // min(most or parts, parts))
    for i in range(0, len(x), step):
        top, cnt = probes(net.probs(x[i : i + step]), most, mass)
        cnt = np.where(role[i : i + step] == 0, 1, cnt)
        at = i + np.repeat(np.arange(len(cnt)), cnt)
        part = top[np.arange(top.shape[1]) < cnt[:, None]]
        yield _batch(vid[at], x[at], cell[at] * (FAN + 1) + part + 1, role[at])


def _runs(batches: Iterator[pa.RecordBatch], most: int | None, mass: float) -> Iterator[pa.RecordBatch]:
    """Rows (vid, u, cell, role, lane, net) sorted by cell, lane and role, routed. Role -1 is the router of the rows that
    follow; a cell without one stays as it is."""
    at, net = None, None
    for b in batches:
        cell, lane = b["cell"].to_numpy(), b["lane"].to_numpy()
        ends = [*(np.flatnonzero((cell[1:] != cell[:-1]) | (lane[1:] != lane[:-1])) + 1).tolist(), len(cell)] if len(cell) else []
        for i, j in zip([0, *ends], ends, strict=False):
            if (cell[i], lane[i]) != at:
                at, net = (cell[i], lane[i]), None
            if b["role"][i].as_py() == -1:
                net, i = Router.of(pickle.loads(b["net"][i].as_py())), i + 1
            if i < j:
                mine = b.slice(i, j - i).select(["vid", "u", "cell", "role"])
                yield from _routed(mine, net, most, mass) if net else [mine]


def _tasks(spark: SparkSession, rows: int) -> int:
    """Tasks for so many rows with their vectors, whatever the session's number of shuffle partitions."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(rows / LANE))


def _cells(st: Stages, rows: DataFrame, part_rows: int, fan: int, sample: int, most: int | None, mass: float) -> DataFrame:
    """(vid, u, cell, role) of all rows (vid, u, cell 0, role), routed level by level into cells of the planned size."""
    schema = "vid long, u array<float>, cell long, role int"

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        net = fit_router(np.stack(pdf["u"].to_numpy()).astype(np.float32), int(pdf["parts"].iloc[0]))
        return pd.DataFrame({"cell": [int(pdf["cell"].iloc[0])], "net": [pickle.dumps(net.w)]} if net else {"cell": [], "net": []}).astype({"cell": "int64"})

    settled = None
    for level in range(LEVELS):
        sizes = rows.groupBy("cell").agg(F.count_if(F.col("role") == 0).alias("n"), F.count(F.lit(1)).alias("n_all"))
        big = st.put(sizes.where(F.col("n") > (SPLIT if level else 1) * part_rows).withColumn("parts", F.least(F.lit(fan), F.ceil(F.col("n") / part_rows)).cast("int")))
        to_route = big.agg(F.sum("n_all")).first()[0]
        if not to_route:
            break
        b = big.select(F.col("cell").alias("b_cell"), "n", "n_all", "parts")
        share = F.pmod(F.xxhash64("vid", F.lit(5 + level)), F.lit(1 << 30)) < F.floor(F.least(F.lit(1.0), F.lit(float(sample)) / F.col("n")) * (1 << 30))
        few = rows.where("role = 0").join(b, F.col("cell") == F.col("b_cell")).where(share).select("cell", "u", "parts")
        nets = st.put(few.groupBy("cell").applyInPandas(fit, "cell long, net binary"))
        if level == 0:  # one cell: its router is one row
            got = nets.collect()
            if not got:
                break
            shared = st.spark.sparkContext.broadcast(bytes(got[0]["net"]))

            def root(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                net = Router.of(pickle.loads(shared.value))
                for x in batches:
                    if len(x):
                        yield from _routed(x, net, most, mass)

            nxt = st.put(rows.mapInArrow(root, schema))
        else:
            rest = rows.join(b, F.col("cell") == F.col("b_cell"), "left_anti")
            settled = rest if settled is None else settled.unionByName(rest)
            n_lanes = F.ceil(F.col("n_all") / LANE)
            lanes = nets.join(b, F.col("cell") == F.col("b_cell")).select(F.lit(None).cast("long").alias("vid"), F.lit(None).cast("array<float>").alias("u"), "cell", F.lit(-1).alias("role"), F.explode(F.sequence(F.lit(0).cast("long"), n_lanes - 1)).alias("lane"), "net")
            mine = rows.join(b, F.col("cell") == F.col("b_cell")).select("vid", "u", "cell", "role", F.pmod(F.xxhash64("vid", "role"), n_lanes).alias("lane"), F.lit(None).cast("binary").alias("net"))
            runs = mine.unionByName(lanes).repartition(_tasks(st.spark, to_route), "cell", "lane").sortWithinPartitions("cell", "lane", "role")
            nxt = st.put(runs.mapInArrow(lambda batches: _runs(batches, most, mass), schema))
        rows = nxt
    return rows if settled is None else st.put(settled.unionByName(rows))


def _search(block: pa.Table, k: int) -> pa.Table:
    """Exact top k of a block's queries among its rows."""
    role = block["role"].to_numpy()
    vid, x = block["vid"].to_numpy(), matrix(block["u"].combine_chunks())
    b, bid, q, qid = x[role == 0], vid[role == 0], x[role == 1], vid[role == 1]
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    m = min(k, len(bid))
    for i in range(0, len(q) if m else 0, 512):
        s = q[i : i + 512] @ b.T
        s[qid[i : i + 512, None] == bid[None, :]] = -2
        at = np.argpartition(-s, m - 1, axis=1)[:, :m]
        sim = np.take_along_axis(s, at, 1)
        keep = sim.ravel() > -1.5
        parts.append((np.repeat(qid[i : i + 512], m)[keep], bid[at].ravel()[keep], sim.ravel()[keep].astype(np.float64)))
    return pa.table(dict(zip(("vid", "near", "sim"), map(np.concatenate, zip(*parts, strict=True)), strict=True)))


def neighbours(rows: DataFrame, id_col: str, vec_col: str, dim: int, k: int = 10, floor: float | None = None, most: int | None = PROBES, mass: float = MASS, part_rows: int = PART_ROWS, fan: int = FAN, sample: int = SAMPLE) -> DataFrame:
    """(id, near, cosine): for each row its k most similar rows of other ids, at least ``floor`` if given.

    Rows whose vector is null, of another length, not finite or all zero are left out, and so are repeated rows and
    null ids. Ties go to the smaller id. A vector under several ids is one vector of the index: its ids are neighbours
    at cosine 1. Of those, and of any vector's ids, the k + 1 smallest can be among the k nearest, so only they travel.
    """
    spark = rows.sparkSession
    st = Stages(spark, "neighbours")
    r = rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where(F.col("id").isNotNull() & usable("v", dim))
    r = st.put(r.groupBy("id", "v").agg(F.count(F.lit(1)).alias("n")).drop("n").withColumn("vid", F.xxhash64("v")))
    first = r.withColumn("rk", F.row_number().over(Window.partitionBy("vid").orderBy("id"))).where(F.col("rk") <= k + 1)
    ids = st.put(first.select("vid", "id", "rk"))
    vecs = r.groupBy("vid").agg(F.first("v").alias("v"))

    def to_unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"vid": pdf["vid"], "u": list(unit(np.stack(pdf["v"].to_numpy())))})

    both = F.explode(F.array(F.lit(0), F.lit(1)).cast("array<int>"))
    uv = st.put(vecs.mapInPandas(to_unit, "vid long, u array<float>"))
    routed = _cells(st, uv.select("vid", "u", F.lit(0).cast("long").alias("cell"), both.alias("role")), part_rows, fan, sample, most, mass)
    # a cell larger than planned is cut into blocks, and its queries into lanes; each block meets each lane once
    plan = routed.groupBy(F.col("cell").alias("p_cell")).agg(F.count_if(F.col("role") == 0).alias("stored"), F.count_if(F.col("role") == 1).alias("asking")).where("stored > 0 and asking > 0")
    plan = st.put(plan.select("p_cell", F.ceil(F.col("stored") / BLOCK).alias("blks"), F.ceil(F.col("asking") / (4 * BLOCK)).alias("lanes"), "stored", "asking"))
    to_search = plan.agg(F.sum(F.col("stored") * F.col("lanes") + F.col("asking") * F.col("blks"))).first()[0] or 0
    h = F.xxhash64("vid", F.lit(8))
    x = routed.join(plan, F.col("cell") == F.col("p_cell"))
    all_of = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    base = x.where("role = 0").select("vid", "u", "cell", "role", F.pmod(h, F.col("blks")).alias("blk"), F.explode(all_of("lanes")).alias("lane"))
    q = x.where("role = 1").select("vid", "u", "cell", "role", F.explode(all_of("blks")).alias("blk"), F.pmod(h, F.col("lanes")).alias("lane"))
    blocks = base.unionByName(q).repartition(_tasks(spark, to_search), "cell", "blk", "lane").groupBy("cell", "blk", "lane")
    found = blocks.applyInArrow(lambda block: _search(block, k), "vid long, near long, sim double")
    if floor is not None:
        found = found.where(F.col("sim") >= floor - 1e-5)
    best = st.put(found.withColumn("rk", F.row_number().over(Window.partitionBy("vid").orderBy(F.desc("sim"), "near"))).where(F.col("rk") <= k).drop("rk"))
    # back to ids: the same vector's other ids, then the near vectors' ids
    same = ids.select("vid", F.col("vid").alias("near"), F.lit(1.0).alias("sim"))
    link = best.unionByName(same.distinct())
    firsts = ids.select(F.col("vid").alias("f_vid"), F.col("id").alias("near_id"))
    link = link.join(firsts, F.col("near") == F.col("f_vid")).select("vid", "near_id", "sim")
    top = link.withColumn("rk", F.row_number().over(Window.partitionBy("vid").orderBy(F.desc("sim"), "near_id"))).where(F.col("rk") <= k + 1 + k).select("vid", "near_id", "sim")
    # one row per vector, so that a vector under very many ids is a hot key of a unique side
    lists = st.put(top.groupBy(F.col("vid").alias("l_vid")).agg(F.collect_list(F.struct("near_id", "sim")).alias("ls")))
    out = r.select("id", "vid").join(lists, F.col("vid") == F.col("l_vid")).select("id", F.explode("ls").alias("x")).select("id", F.col("x.near_id").alias("near_id"), F.col("x.sim").alias("sim"))
    out = out.where(F.col("id") != F.col("near_id")).groupBy("id", "near_id").agg(F.max("sim").alias("sim"))
    out = out.withColumn("rk", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "near_id"))).where(F.col("rk") <= k)
    if floor is not None:
        out = out.where(F.col("sim") >= floor)
    return out.select(F.col("id").alias(id_col), F.col("near_id").alias("near"), F.col("sim").alias("cosine"))


def recall(rows: DataFrame, id_col: str, vec_col: str, dim: int, k: int = 10, every: int = 100, **how) -> DataFrame:
    """(queries, found, wanted, recall) of :func:`neighbours` (with ``how``) against exact ranking, for the ids divisible by ``every``.

    The stated query set is split into blocks of ``BLOCK`` rows; each block is ranked against every batch of all rows.
    A near row counts as found if it is in the answer or ties with the answer's last.
    """
    spark = rows.sparkSession
    st = Stages(spark, "recall")
    got = st.put(neighbours(rows, id_col, vec_col, dim, k, **how).where(F.col(id_col) % every == 0).select(id_col, "near", "cosine"))
    r = st.put(rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where(F.col("id").isNotNull() & usable("v", dim)).groupBy("id", "v").agg(F.count(F.lit(1)).alias("n")).drop("n"))
    qs = r.where(F.col("id") % every == 0)
    n_blocks = max(1, math.ceil(qs.count() / BLOCK))
    qs = st.put(qs.withColumn("blk", F.pmod(F.xxhash64("id", "v"), F.lit(n_blocks)).cast("int")))
    best = None
    for b in range(n_blocks):
        pdf = qs.where(F.col("blk") == b).toPandas()
        if pdf.empty:
            continue
        shared = spark.sparkContext.broadcast((pdf["id"].to_numpy(), unit(np.stack(pdf["v"].to_numpy()))))

        def rank(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            qid, q = shared.value
            for x in batches:
                if not len(x):
                    continue
                i = x["id"].to_numpy()
                s = q @ unit(np.stack(x["v"].to_numpy())).T
                s[qid[:, None] == i[None, :]] = -2
                m = min(2 * k, len(i))
                at = np.argpartition(-s, m - 1, axis=1)[:, :m]
                sim = np.take_along_axis(s, at, 1).ravel()
                yield pd.DataFrame({"id": np.repeat(qid, m), "near": i[at].ravel(), "sim": sim.astype(np.float64)})[sim > -1.5]

        part = r.mapInPandas(rank, "id long, near long, sim double")
        best = part if best is None else best.unionByName(part)
    if best is None:
        return spark.createDataFrame([(0, 0, 0, 1.0)], "queries long, found long, wanted long, recall double")
    best = best.groupBy("id", "near").agg(F.max("sim").alias("sim"))
    best = best.withColumn("rk", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "near"))).where(F.col("rk") <= k)
    last = got.groupBy(F.col(id_col).alias("g_id")).agg(F.min("cosine").alias("last"))
    g = got.select(F.col(id_col).alias("h_id"), F.col("near").alias("h_near"), F.lit(True).alias("hit"))
    j = best.join(g, (F.col("id") == F.col("h_id")) & (F.col("near") == F.col("h_near")), "left").join(last, F.col("id") == F.col("g_id"), "left")
    ok = F.coalesce(F.col("hit"), F.lit(False)) | (F.coalesce(F.col("last"), F.lit(2.0)) >= F.col("sim") - 1e-6) & F.col("last").isNotNull()
    return j.agg(F.count_distinct("id").alias("queries"), F.count_if(ok).alias("found"), F.count(F.lit(1)).alias("wanted")).withColumn("recall", F.col("found") / F.col("wanted"))
