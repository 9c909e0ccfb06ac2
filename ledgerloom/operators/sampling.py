"""Neighbour sampling, multi-hop sampling, link-prediction splits and negatives
(R8, R9, K1, K2, W11, W12, J7, J8).

Random choices hash (seed, key) instead of drawing from a stateful generator (``draw60``), so
results do not depend on partitioning or task retries and SQL can repeat them (they are not
the reference's Mersenne-Twister draws).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import draw60
from ..plans.ordering import windowed, with_cumulative_sums, with_global_rank
from ..session import cut_lineage

_BLOCK = 1000      # draws per generated array
_FIRST_DRAWS = 2   # draws tried at first, in multiples of the negatives asked for


def in_neighbours(edges: DataFrame, id_col: str = "edge_id") -> DataFrame:
    """(u, v, edge): u receives from v; parallel edges stay apart by their id."""
    return edges.select(F.col("dst").alias("u"), F.col("src").alias("v"), F.col(id_col).alias("edge"))


def sample_neighbors(adj: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(node, slot, neighbor, edge) with exactly k entries per node that has any.

    ``adj(u, v, edge)`` may hold parallel edges, each of which can be drawn.  k <= 0 -> all.
    Nodes with at least k entries keep the k with the smallest hash of (seed, node, neighbor,
    edge) (``row_number <= k``; Spark applies the limit per map partition before the shuffle,
    so a hub sends at most k rows per partition).  Nodes with fewer draw with replacement: slot
    j takes the entry at position hash(seed, node, j) mod degree of the same order."""
    a = adj.select(F.col("u").alias("node"), F.col("v").alias("neighbor"), "edge")
    if k <= 0:
        return a.withColumn("slot", F.lit(None).cast("int")).select("node", "slot", "neighbor", "edge")
    h = draw60(F.lit(seed), F.col("node"), F.col("neighbor"), F.col("edge"))
    w = Window.partitionBy("node").orderBy(h, F.col("neighbor"), F.col("edge"))
    # filtering on row_number directly lets Spark insert a partial WindowGroupLimit before the
    # shuffle: at most k rows per node and map partition move, whatever the degree
    top = a.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k) \
        .withColumn("_pos", F.col("_rn") - 1).drop("_rn")
    deg = a.groupBy("node").agg(F.count(F.lit(1)).alias("_deg"))
    top = top.join(deg, "node")
    full = top.where(F.col("_deg") >= k).select("node", F.col("_pos").cast("int").alias("slot"), "neighbor", "edge")
    small = deg.where(F.col("_deg") < k).select("node", "_deg", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("slot"))
    small = small.withColumn("_pos", F.pmod(draw60(F.lit(seed), F.col("node"), F.col("slot")), F.col("_deg")))
    # a node below k has all its entries inside ``top`` (every rank <= k)
    pad = small.join(top.select("node", "_pos", "neighbor", "edge"), ["node", "_pos"]).select("node", "slot", "neighbor", "edge")
    return full.unionByName(pad)


def multi_hop_sample(adj: DataFrame, targets: DataFrame, fanouts: list[int], seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Hop h samples ``fanouts[h]`` neighbours of the nodes first reached at hop h (hop 1 =
    direct neighbours of the targets, D16).  Returns (edges(hop, node, slot, neighbor, edge),
    nodes(node, local_index, hop)) with the targets first (by id) and then new nodes by (first
    hop, id)."""
    frontier = targets.select("node").distinct()
    seen = frontier.withColumn("_hop", F.lit(0))
    edges = None
    for h, k in enumerate(fanouts, start=1):
        s = sample_neighbors(adj.join(frontier.select(F.col("node").alias("u")), "u", "left_semi"), k, seed + h)
        s = s.withColumn("hop", F.lit(h))
        edges = s if edges is None else edges.unionByName(s)
        new = s.select(F.col("neighbor").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        seen = seen.unionByName(new.withColumn("_hop", F.lit(h)))
        frontier = new
    idx = with_global_rank(seen, ["_hop", "node"], "local_index").select("node", "local_index", F.col("_hop").alias("hop"))
    return edges.select("hop", "node", "slot", "neighbor", "edge"), idx


def _ledger_ranks(e: DataFrame) -> DataFrame:
    return cut_lineage(with_global_rank(e.select("t").distinct(), ["t"], "r").select("t", "r"))


def _to_splits(rows: DataFrame, ranked: DataFrame, n_future: int, context_ledgers: int) -> DataFrame:
    """rows(t, ...) -> (split, part, ...): each row in the (at most context_ledgers + n_future) splits
    that contain its ledger; the theta join becomes an equi join on the boundary."""
    rest = [c for c in rows.columns if c != "t"]
    # context: boundary rank r_b in [r + 1, r + K]
    ctx = rows.join(ranked, "t").select(*rest, F.explode(F.sequence(F.col("r") + 1, F.col("r") + context_ledgers)).alias("rb"))
    ctx = ctx.join(ranked.select(F.col("r").alias("rb"), F.col("t").alias("split")), "rb").drop("rb")
    # future: boundary value in (t - n_future, t] among existing ledgers but the first
    fut = rows.select(*rest, F.explode(F.sequence(F.col("t") - (n_future - 1), F.col("t"))).alias("split"))
    fut = fut.join(ranked.where("r > 0").select(F.col("t").alias("split")), "split", "left_semi")
    return ctx.select("split", F.lit("context").alias("part"), *rest).unionByName(
        fut.select("split", F.lit("future").alias("part"), *rest))


def split_edges(edges: DataFrame, ledger_col: str = "ledger", n_future: int = 5, context_ledgers: int = 10) -> DataFrame:
    """(split, part, src, dst) of every boundary ledger with a context and a future:
    context = edges of the last ``context_ledgers`` distinct ledgers before it; future = edges
    with split <= ledger < split + n_future.  The edges are materialised once."""
    e = cut_lineage(edges.select(F.col(ledger_col).cast("long").alias("t"), "src", "dst"))
    return _to_splits(e, _ledger_ranks(e), n_future, context_ledgers)


def link_prediction_splits(edges: DataFrame, ledger_col: str = "ledger", n_future: int = 5,
                           context_ledgers: int = 10) -> DataFrame:
    """K1: one row per split: n_context, n_future and the number of distinct accounts in both.

    Edges are reduced before they meet the splits: to one number per ledger for the counts, to the
    distinct (ledger, account) for the accounts, and these to the boundaries where an account begins
    and ends to count; neither an edge nor an account is expanded to its splits."""
    e = cut_lineage(edges.select(F.col(ledger_col).cast("long").alias("t"), "src", "dst"))
    ranked = _ledger_ranks(e)
    per_ledger = _to_splits(e.groupBy("t").agg(F.count(F.lit(1)).alias("n")), ranked, n_future, context_ledgers)
    part = lambda p: F.coalesce(F.sum(F.when(F.col("part") == p, F.col("n"))), F.lit(0)).alias(f"n_{p}")
    counts = per_ledger.groupBy("split").agg(part("context"), part("future"))
    accounts = e.select("t", F.explode(F.array("src", "dst")).alias("node")).where("node is not null").distinct()
    # a ledger of rank r lies in the splits of the boundary ranks first .. r + context_ledgers, without gap
    first = ranked.select("t", F.explode(F.sequence(F.col("t") - (n_future - 1), F.col("t"))).alias("b")).join(
        ranked.where("r > 0").select(F.col("t").alias("b"), F.col("r").alias("rb")), "b").groupBy("t").agg(F.min("rb").alias("first"))
    spans = ranked.join(first, "t", "left").select("t", "r", F.coalesce("first", F.col("r") + 1).alias("first"))
    seen = windowed(accounts.join(spans, "t"), ["node"], ["r"], 1, 0, lambda w: [F.lag("r").over(w).alias("_before")])
    # an account counts from where its previous ledger stops counting it
    begin = F.greatest("first", F.col("_before") + context_ledgers + 1)
    steps = seen.select(F.explode(F.array(F.struct(begin.alias("r"), F.lit(1).alias("s")),
                                          F.struct((F.col("r") + context_ledgers + 1).alias("r"), F.lit(-1).alias("s")))).alias("x"))
    steps = steps.groupBy("x.r").agg(F.sum("x.s").alias("s"))
    nodes = with_cumulative_sums(ranked.join(steps, "r", "left").select("t", "r", F.coalesce("s", F.lit(0)).alias("s")), ["r"], ["s"])
    return counts.join(nodes.select(F.col("t").alias("split"), F.col("cum_s").alias("n_nodes")), "split") \
        .withColumnRenamed("split", "boundary")


def negative_samples(split_nodes: DataFrame, positives: DataFrame, n_neg: DataFrame, seed: int = 42,
                     budget: int = 10) -> DataFrame:
    """Per split s, draws i < budget * n_neg(s) of (u, v) = positions
    hash(seed, s, i, 0|1) mod N(s) in the split's sorted node list; u != v, not a positive pair,
    unique; the n_neg(s) draws with the smallest i are kept (fewer when the graph is too dense,
    as the reference returns fewer).  Draws are generated in blocks, so a large split is no
    large row.

    The first ``_FIRST_DRAWS * n_neg(s)`` draws are tried first, the others only in splits that these
    leave short: no later draw can come before one that is kept."""
    n = split_nodes.groupBy("split").agg(F.count(F.lit(1)).alias("_N"))
    idx = rank_within(split_nodes.select("split", "node"), ["split"], ["node"], "_i")
    sizes = cut_lineage(n_neg.join(n, "split").select("split", "n_neg", "_N"))
    first = min(_FIRST_DRAWS, budget)
    found = cut_lineage(_valid_draws(sizes, idx, positives, seed, 0, first))
    got = found.groupBy("split").agg(F.count(F.lit(1)).alias("_got"))
    short = sizes.join(got, "split", "left").where(F.coalesce("_got", F.lit(0)) < F.col("n_neg")).drop("_got")
    if first < budget and not (short := cut_lineage(short)).isEmpty():
        more = _valid_draws(short, idx, positives, seed, first, budget)
        found = found.unionByName(more).groupBy("split", "u", "v").agg(F.min("draw").alias("draw"), F.first("n_neg").alias("n_neg"))
    ranked = rank_within(found, ["split"], ["draw"], "_k")
    return ranked.where(F.col("_k") < F.col("n_neg")).select("split", "u", "v")


def _valid_draws(sizes: DataFrame, idx: DataFrame, positives: DataFrame, seed: int, begin: int, end: int) -> DataFrame:
    """(split, u, v, draw, n_neg): the valid pairs among the draws begin * n_neg <= i < end * n_neg, each with
    its first draw.

    The blocks of draws are few small rows: what is made of them must not be broadcast on their measured
    size, hence the join hints."""
    lo, hi = F.col("n_neg") * begin, F.col("n_neg") * end
    d = sizes.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((hi - lo - 1) / _BLOCK))).alias("_b"))
    d = d.repartition("split", "_b")
    d = d.select("split", "n_neg", "_N", F.explode(F.sequence(
        lo + F.col("_b") * _BLOCK, F.least(lo + F.col("_b") * _BLOCK + _BLOCK, hi) - 1)).alias("draw"))
    at = lambda side: F.pmod(draw60(F.lit(seed), F.col("split"), F.col("draw"), F.lit(side)), F.col("_N"))
    d = d.select("split", "n_neg", "draw", at(0).alias("_u"), at(1).alias("_v")).where(F.col("_u") != F.col("_v"))
    d = d.hint("merge").join(idx.select("split", F.col("_i").alias("_u"), F.col("node").alias("u")), ["split", "_u"])
    d = d.hint("merge").join(idx.select("split", F.col("_i").alias("_v"), F.col("node").alias("v")), ["split", "_v"])
    d = d.groupBy("split", "u", "v").agg(F.min("draw").alias("draw"), F.first("n_neg").alias("n_neg"))
    return d.hint("merge").join(positives.select("split", F.col("src").alias("u"), F.col("dst").alias("v")), ["split", "u", "v"], "left_anti")


def rank_within(df: DataFrame, group_cols: list[str], order_cols: list[str], out: str) -> DataFrame:
    """0-based position inside each group in ``order_cols`` order (total within the group):
    a range-partitioned global rank minus the group's first rank (grouped min), so one huge
    group is spread over many tasks instead of one window task."""
    r = with_global_rank(df, [*group_cols, *order_cols], "_gr")
    first = r.groupBy(*group_cols).agg(F.min("_gr").alias("_g0"))
    return r.join(first, group_cols).withColumn(out, F.col("_gr") - F.col("_g0")).drop("_gr", "_g0")
