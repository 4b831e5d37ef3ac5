"""Parent-child rows to full hierarchies, by heavy-path decomposition.

1. *Cycle separation and subtree sizes.* Parent pointers are doubled: after k rounds every node knows its ancestor 2^k
   steps up, the smallest id on the way there, and how many nodes lie within 2^k steps below it (its own count plus those
   of the nodes that jump to it). Nodes that still have an ancestor when nothing changes any more are on a loop or below
   one; a loop is cut at its smallest id.
2. *Heavy paths.* The largest child continues its parent's chain (on a loop: the loop does), every other child heads a new
   one. Doubling along heavy edges gives each node its chain's head and its place in the chain.
3. *Chains.* A root path crosses at most log2(n) + 1 chains. Depth, root and visiting number are carried from chain to
   chain: head's depth + place, head's number + place. Nothing collects a chain: its nodes are joined by their head.
4. *Labels.* Visiting the heavy child first numbers each chain consecutively, so a node's descendants are exactly the
   interval [pre, pre + size) within its root. :func:`paths` concatenates chain segments.

A parent with very many children, or a jump target of very many nodes, is one key of a join whose other side is unique:
adaptive execution splits such a partition. Two doublings are one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Stages

SIBLING_BUCKET = 20_000  # light children of one parent per prefix-sum task
BLOCK_BITS = 8  # intervals are joined in aligned blocks of at most 2^8 places, so no join key holds more nodes
SEGMENT = 256  # places of a chain whose names one window collects


def clean_edges(df: DataFrame, id_col: str, parent_col: str, name_col: str, version_col: str | None = None) -> DataFrame:
    """One row (id, parent, name) per id: the last loaded one, on ties the smallest parent and name. Null ids are dropped."""
    cols = [F.col(id_col).cast("long").alias("id"), F.col(parent_col).cast("long").alias("parent"), F.col(name_col).cast("string").alias("name")]
    v = F.col(version_col) if version_col else F.lit(0)
    picked = df.select(*cols, v.alias("v")).where(F.col("id").isNotNull())
    # min_by over (parent, name) after max over v, in one pass: order by v descending through a negated epoch
    order = -F.unix_micros(F.col("v").cast("timestamp")) if version_col else F.lit(0).cast("long")
    return (
        picked.groupBy("id")
        .agg(F.min(F.struct(F.coalesce(order, F.lit(2**63 - 1)).alias("o"), F.col("parent"), F.col("name"))).alias("m"))
        .select("id", "m.parent", "m.name")
    )


def _renamed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def _climb(state: DataFrame) -> DataFrame:
    """One doubling of (id, jump, low, size); jump is null past a root."""
    below = state.where("jump is not null").groupBy(F.col("jump").alias("b_id")).agg(F.sum("size").alias("b_size"))
    up = _renamed(state.select("id", "jump", "low"), "u_")
    active = state.where("jump is not null").join(up, F.col("jump") == F.col("u_id")).select("id", F.col("u_jump").alias("jump"), F.least("low", "u_low").alias("low"), "size", "was")
    moved = active.unionByName(state.where("jump is null"))
    return moved.join(below, F.col("id") == F.col("b_id"), "left").select("id", "jump", "low", (F.col("size") + F.coalesce("b_size", F.lit(0))).alias("size"), "was")


def _separate(st: Stages, e: DataFrame) -> tuple[DataFrame, int]:
    """(id, jump, low, size) at rest, and how many nodes never reach a root. A jump that is left leads onto the loop."""
    one = F.lit(1).cast("long")
    state = e.select("id", F.col("parent").alias("jump"), F.least("id", "parent").alias("low"), one.alias("size"))
    left = heads = None
    while True:
        state = state.select("id", "jump", "low", "size", F.col("low").alias("was"))
        nxt = st.put(_climb(_climb(state)))
        active = F.col("jump").isNotNull()
        r = nxt.agg(F.count_if(active).alias("left"), F.count_if(active & (F.col("low") < F.col("was"))).alias("fell")).first()
        st.drop(state)
        state = nxt
        if not r["left"]:
            return nxt, 0
        # no node of a depth up to twice the last one is left, no smallest id fell: are the jumps' targets the loops?
        same = r["left"] == left and not r["fell"]
        left, now = r["left"], nxt.where(active).select("jump").distinct().count() if same else None
        if same and now == heads:
            return nxt, left
        heads = now


def _heads(st: Stages, tree: DataFrame) -> DataFrame:
    """(id, head, pos) by doubling along heavy edges."""
    state = tree.select("id", F.when(F.col("heavy"), F.col("parent")).alias("jump"), F.when(F.col("heavy"), F.col("parent")).otherwise(F.col("id")).alias("head"), F.col("heavy").cast("long").alias("pos"))

    def step(s: DataFrame) -> DataFrame:
        up = _renamed(s, "u_")
        on = s.where("jump is not null").join(up, F.col("jump") == F.col("u_id"))
        return on.select("id", F.col("u_jump").alias("jump"), F.col("u_head").alias("head"), (F.col("pos") + F.col("u_pos")).alias("pos")).unionByName(s.where("jump is null"))

    while True:
        nxt = st.put(step(step(state)))
        left = nxt.where("jump is not null").limit(1).count()
        st.drop(state)
        state = nxt
        if not left:
            return state.select("id", "head", "pos")


def _carry(st: Stages, chains: DataFrame, add: dict) -> DataFrame:
    """Chains (h, up, ...) with the values of ``add`` (column -> how a chain's value and its upper chain's combine) carried
    down from the top, and ``top``, the topmost chain. log2 of the number of chains on a path rounds."""
    state = chains.withColumn("top", F.coalesce("up", "h"))
    while True:
        up = _renamed(state, "u_")
        on = state.where("up is not null").join(up, F.col("up") == F.col("u_h"))
        on = on.select("h", F.col("u_up").alias("up"), F.col("u_top").alias("top"), *[f(F.col("u_" + c), F.col(c)).alias(c) for c, f in add.items()])
        nxt = st.put(on.unionByName(state.where("up is null")))
        left = nxt.where("up is not null").limit(1).count()
        st.drop(state)
        state = nxt
        if not left:
            return state


def _offsets(st: Stages, light: DataFrame) -> DataFrame:
    """(o_id, o): the sizes of a light child's elder light siblings (parent, id, size), summed in buckets of
    ``SIBLING_BUCKET`` so that no parent's children meet in one task."""
    fan = light.groupBy(F.col("parent").alias("f_parent")).agg(F.count(F.lit(1)).alias("f_n"))
    light = st.put(light.join(fan, F.col("parent") == F.col("f_parent")).select("id", "parent", "size", F.pmod(F.xxhash64("id"), F.ceil(F.col("f_n") / SIBLING_BUCKET)).alias("bucket")))
    sums = light.groupBy(F.col("parent").alias("p"), F.col("bucket").alias("b")).agg(F.sum("size").alias("s"))
    before = sums.select("p", "b", (F.sum("s").over(Window.partitionBy("p").orderBy("b")) - F.col("s")).alias("base"))
    within = light.withColumn("run", F.sum("size").over(Window.partitionBy("parent", "bucket").orderBy("id")) - F.col("size"))
    return within.join(before, (F.col("parent") == F.col("p")) & (F.col("bucket") == F.col("b"))).select(F.col("id").alias("o_id"), (F.col("base") + F.col("run")).alias("o"))


def hierarchy(edges: DataFrame) -> DataFrame:
    """Full hierarchy of ``edges`` (id, parent, name; one row per id, see :func:`clean_edges`).

    Result: id, parent, name, state, root, depth, size, pre, level, entry, loop_len, head, pos.

    * ``ok``: the chain of parents ends at a node without parent. ``broken``: at a node whose parent has no row.
    * ``cycle``: on a loop (also of one). ``below``: leads into one. Both: root = smallest id of the loop, depth -1.
    * level: steps to the root, which of a loop is its smallest id. entry: level of the loop's node that a node hangs on;
      loop_len: the loop's length; both null for ``ok`` and ``broken``.
    * head, pos: the first node of the node's heavy chain and the place in it.
    * descendants of a node (itself included): same root, pre in [pre, pre + size). Of a loop's member they are the other
      members and all that hangs below the loop, and size counts them all.

    An empty table gives an empty result; null ids must have been dropped.
    """
    spark = edges.sparkSession
    st = Stages(spark, "hierarchy")
    e0 = edges.select("id", "parent", "name")
    known = e0.select(F.col("id").alias("k_id"))
    linked = e0.where("parent is not null").join(known, F.col("parent") == F.col("k_id"), "left").select("id", F.col("k_id").alias("parent"), F.col("parent").alias("written"), "name")
    e = st.put(linked.unionByName(e0.where("parent is null").select("id", "parent", F.col("parent").alias("written"), "name")))
    state, looped = _separate(st, e.select("id", "parent"))
    base = e.join(state.select(F.col("id").alias("s_id"), "size"), F.col("id") == F.col("s_id")).select("id", "parent", "written", "name", "size", F.lit(None).cast("long").alias("low"), F.lit(False).alias("on_loop"))
    if looped:
        act = state.where("jump is not null")
        on = act.select(F.col("jump").alias("l_id")).distinct()
        mine = act.select(F.col("id").alias("m_id"), F.col("jump").alias("m_jump")).join(state.select(F.col("id").alias("j_id"), F.col("low").alias("m_low")), F.col("m_jump") == F.col("j_id")).select("m_id", "m_low")
        mine = mine.join(on, F.col("m_id") == F.col("l_id"), "left").select("m_id", "m_low", F.col("l_id").isNotNull().alias("m_on"))
        base = base.drop("low", "on_loop").join(mine, F.col("id") == F.col("m_id"), "left").select("id", "parent", "written", "name", "size", F.col("m_low").alias("low"), F.coalesce("m_on", F.lit(False)).alias("on_loop"))
        base = base.withColumn("parent", F.when(~F.col("on_loop") | (F.col("id") != F.col("low")), F.col("parent")))
    base = st.put(base)
    # heavy children; what hangs on a loop hangs on its smallest id for the visiting order
    kids = base.where("parent is not null")
    rank = F.struct(F.col("on_loop").alias("on"), F.col("size").alias("s"), (-F.col("id")).alias("n"))
    heavy = kids.groupBy(F.col("parent").alias("h_parent")).agg(F.max(rank).alias("m")).select("h_parent", (-F.col("m.n")).alias("h_id"), F.col("m.s").alias("h_size"), F.col("m.on").alias("h_on"))
    if looped:  # a loop's chain ends with the loop
        members = base.where("on_loop").select(F.col("id").alias("x_id"))
        heavy = heavy.where("h_on").unionByName(heavy.where("not h_on").join(members, F.col("h_parent") == F.col("x_id"), "left_anti"))
    tree = base.join(heavy.select("h_id"), F.col("id") == F.col("h_id"), "left").withColumn("heavy", F.col("h_id").isNotNull()).drop("h_id")
    tree = st.put(tree)
    chain = st.put(_heads(st, tree).join(tree.withColumnRenamed("id", "t_id"), F.col("id") == F.col("t_id")).drop("t_id"))
    # one row per chain: where it hangs, and by how much its first node comes after its parent
    hd = chain.where("id = head").select(F.col("id").alias("h"), "parent", "size", "low", "on_loop", (F.col("written").isNotNull() & F.col("parent").isNull() & F.col("low").isNull()).alias("torn"))
    par = chain.select(F.col("id").alias("p_id"), F.col("head").alias("p_head"), F.col("pos").alias("p_pos"), F.col("on_loop").alias("p_on"))
    hung = hd.where("parent is not null").join(par, F.col("parent") == F.col("p_id"))
    hung = st.put(hung.select("h", F.when(F.col("p_on"), F.col("low")).otherwise(F.col("parent")).alias("at"), "size", "p_head", "p_pos", "p_on"))
    offs = _offsets(st, hung.select(F.col("h").alias("id"), F.col("at").alias("parent"), "size"))
    loops = chain.where("on_loop").groupBy(F.col("low").alias("z_low")).agg(F.count(F.lit(1)).alias("loop_len"))
    first = heavy.where("not h_on").select("h_parent", "h_size")
    j = hung.join(offs, F.col("h") == F.col("o_id")).join(first, F.col("at") == F.col("h_parent"), "left").join(loops, F.col("at") == F.col("z_low"), "left")
    ahead = F.when(F.col("p_on"), F.col("loop_len")).otherwise(1 + F.coalesce("h_size", F.lit(0)) + F.col("p_pos"))
    null = lambda t: F.lit(None).cast(t)
    j = j.select("h", F.col("p_head").alias("up"), (ahead + F.col("o")).alias("c_pre"), (F.col("p_pos") + 1).alias("c_level"), F.col("p_pos").alias("entry"), null("boolean").alias("torn"))
    zero = F.lit(0).cast("long")
    tops = hd.where("parent is null").select("h", null("long").alias("up"), zero.alias("c_pre"), zero.alias("c_level"), null("long").alias("entry"), "torn")
    plus = lambda above, own: above + own
    upper = lambda above, own: F.coalesce(above, own)
    done = _carry(st, tops.unionByName(j), {"c_pre": plus, "c_level": plus, "entry": upper, "torn": upper})
    n = chain.join(done.drop("up"), F.col("head") == F.col("h"))
    comp = chain.where("low is not null").groupBy(F.col("low").alias("y_low")).agg(F.count(F.lit(1)).alias("all"), F.count_if("on_loop").alias("loop_len"))
    inside = F.col("low").isNotNull()
    level = F.col("c_level") + F.col("pos")
    cols = lambda size, loop_len: [
        "id", F.col("written").alias("parent"), "name", F.when(F.col("on_loop"), "cycle").when(inside, "below").when(F.col("torn"), "broken").otherwise("ok").alias("state"),
        F.col("top").alias("root"), F.when(inside, F.lit(-1).cast("long")).otherwise(level).alias("depth"), size.alias("size"), (F.col("c_pre") + F.col("pos")).alias("pre"), level.alias("level"),
        F.when(F.col("on_loop"), F.col("pos")).when(inside, F.col("entry")).alias("entry"), loop_len.alias("loop_len"), "head", "pos",
    ]
    out = n.where(~inside).select(*cols(F.col("size"), null("long")))
    if looped:
        around = n.where(inside).join(comp, F.col("low") == F.col("y_low"))
        out = out.unionByName(around.select(*cols(F.when(F.col("on_loop"), F.col("all")).otherwise(F.col("size")), F.col("loop_len"))))
    return out


def paths(h: DataFrame, sep: str = "/") -> DataFrame:
    """(id, path) for the result of :func:`hierarchy`: the names from the root; below a loop from the member that the tree
    hangs on; of a loop's member its own name. Null names are empty parts.

    A path holds as many names as its node is deep, so all paths of a chain of n nodes hold n²/2 names.
    """
    st = Stages(h.sparkSession, "paths")
    on = F.col("state") == "cycle"
    x = h.select("id", "parent", on.alias("on"), "head", "pos", F.coalesce("name", F.lit("")).alias("name"), F.floor(F.col("pos") / SEGMENT).alias("blk"))
    x = st.put(x)
    chains = x.where("not on")
    w = Window.partitionBy("head", "blk").orderBy("pos")
    seg = chains.withColumn("seg", F.array_join(F.collect_list("name").over(w), sep))
    whole = seg.groupBy(F.col("head").alias("w_head"), F.col("blk").alias("w_blk")).agg(F.max_by("seg", "pos").alias("s"))
    earlier = whole.select("w_head", "w_blk", F.array_join(F.collect_list("s").over(Window.partitionBy("w_head").orderBy("w_blk").rowsBetween(Window.unboundedPreceding, -1)), sep).alias("lead"))
    seg = seg.join(earlier, (F.col("head") == F.col("w_head")) & (F.col("blk") == F.col("w_blk")))
    seg = st.put(seg.select("id", "parent", "head", "pos", F.when(F.col("blk") > 0, F.concat("lead", F.lit(sep), "seg")).otherwise(F.col("seg")).alias("seg")))
    members = x.where("on").select(F.col("id").alias("p_id"), F.lit(None).cast("long").alias("up"), F.col("name").alias("text"))
    at = seg.select(F.col("id").alias("p_id"), F.col("head").alias("up"), F.col("seg").alias("text")).unionByName(members)
    hd = seg.where("pos = 0").select(F.col("head").alias("h"), "parent")
    ch = hd.join(at, F.col("parent") == F.col("p_id"), "left").select("h", "up", "text")
    join_ = lambda above, own: F.when(above.isNull(), own).otherwise(F.concat(above, F.lit(sep), own))
    done = _carry(st, ch, {"text": join_}).select("h", "text")
    named = seg.join(done, F.col("head") == F.col("h")).select("id", F.when(F.col("text").isNull(), F.col("seg")).otherwise(F.concat("text", F.lit(sep), "seg")).alias("path"))
    return named.unionByName(x.where("on").select("id", F.col("name").alias("path")))


def descendants(h: DataFrame) -> DataFrame:
    """(id, descendant, distance) for every node and each node below it, itself excluded; a loop's members are below each other.

    The interval [pre, pre + size) is cut into aligned blocks of 2^k places, k up to ``BLOCK_BITS``, at most two of each
    smaller size; a node lies in one block of each size. So the range join is an equality join on root, k and block that
    yields result rows only.
    """
    on = F.col("state") == "cycle"
    start = F.when(on, F.lit(0).cast("long")).otherwise(F.col("pre") + 1)
    end = F.when(on, F.col("size")).otherwise(F.col("pre") + F.col("size"))
    blocks = []
    for k in range(BLOCK_BITS + 1):
        a, b = F.ceil(start / F.lit(2**k)).cast("long"), F.floor(end / F.lit(2**k)).cast("long")
        if k == BLOCK_BITS:
            cut = F.when(a < b, F.sequence(a, b - 1))
        else:
            cut = F.when(a < b, F.filter(F.array(F.when(a % 2 == 1, a), F.when(b % 2 == 1, b - 1)), lambda v: v.isNotNull()))
        cut = F.coalesce(cut, F.expr("cast(array() as array<bigint>)"))
        blocks.append(F.arrays_zip(F.array_repeat(F.lit(k), F.size(cut)).alias("k"), cut.alias("v")))
    above = h.where("size > 1").select("id", F.col("root").alias("a_root"), on.alias("a_on"), F.col("level").alias("a_level"), "loop_len", F.explode(F.flatten(F.array(*blocks))).alias("a"))
    places = F.transform(F.sequence(F.lit(0), F.lit(BLOCK_BITS)), lambda k: F.struct(k.alias("k"), F.floor(F.col("pre") / F.pow(F.lit(2.0), k)).cast("long").alias("v")))
    below = h.select(F.col("id").alias("descendant"), "root", "level", "entry", F.explode(places).alias("b"))
    x = above.join(below, (F.col("a_root") == F.col("root")) & (F.col("a.k") == F.col("b.k")) & (F.col("a.v") == F.col("b.v"))).where("id <> descendant")
    around = F.when(F.col("a_on") & (F.col("entry") < F.col("a_level")), F.col("loop_len")).otherwise(0)
    return x.select("id", "descendant", (F.col("level") - F.col("a_level") + around).alias("distance"))
