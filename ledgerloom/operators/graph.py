"""Iterative and structural graph operators.

Iterative operators are driver loops over DataFrames: each round is a join + grouped
aggregate, the new state is written with a reliable checkpoint (``spark.checkpoint.dir``;
never a local checkpoint) and the stop test is one scalar action.  Edge conventions follow
the reference per operator (null endpoints dropped; PageRank/eigenvector keep self-loops and
sum parallel edges; BFS-based metrics use the undirected distinct adjacency).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import draw60
from ..session import IterationState, cut_lineage
from ..sources.files import passed, stored
from . import tiles
from .inside import Inside


def falsy_weight(amount: Column) -> Column:
    """0 and null amounts weigh 1.0 (the reference's ``amount or 1.0``)."""
    return F.when(amount.isNull() | (amount == 0), F.lit(1.0)).otherwise(amount.cast("double"))


def weighted_pairs(edges: DataFrame, weighted: bool = True) -> DataFrame:
    """(src, dst, w): parallel edges summed, null endpoints dropped, self-loops kept."""
    e = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    w = falsy_weight(F.col("amount")) if weighted else F.lit(1.0)
    return e.groupBy("src", "dst").agg(F.sum(w).alias("w"))


def node_table(edges: DataFrame, extra_nodes: DataFrame | None = None, drop_null_edges: bool = True) -> DataFrame:
    """Distinct nodes of edges with both endpoints (plus ``extra_nodes.node``)."""
    e = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()) if drop_null_edges else edges
    n = e.select(F.col("src").alias("node")).union(e.select(F.col("dst").alias("node")))
    if extra_nodes is not None:
        n = n.union(extra_nodes.select("node"))
    return n.where(F.col("node").isNotNull()).distinct()


def undirected_adjacency(edges: DataFrame, keep_self_loops: bool = False) -> DataFrame:
    """(u, v) both directions of every distinct undirected pair."""
    pairs = undirected_pairs(edges)
    return mirrored(pairs if keep_self_loops else pairs.where("a <> b"))


def undirected_pairs(edges: DataFrame) -> DataFrame:
    """(a, b), a <= b: every distinct undirected pair once, null endpoints dropped, self-loops kept."""
    e = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    return e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def mirrored(pairs: DataFrame) -> DataFrame:
    """pairs(a, b) -> (u, v) in both directions, a self-loop once."""
    there = F.struct(F.col("a").alias("u"), F.col("b").alias("v"))
    back = F.struct(F.col("b").alias("u"), F.col("a").alias("v"))
    return pairs.select(F.explode(F.when(F.col("a") == F.col("b"), F.array(there)).otherwise(F.array(there, back))).alias("e")).select("e.*")


def numbered_graph(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes(node, nid), pairs(a, b)): nodes numbered in their order, and every distinct undirected pair
    of different nodes once, by numbers a < b.

    The edges are read once; what rounds move, sort and add up are numbers, not texts."""
    from ..plans.ordering import with_global_rank
    pairs = passed(undirected_pairs(edges))
    nodes = passed(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    ranges = max(edges.sparkSession.sparkContext.defaultParallelism, nodes.count() >> 20)   # estimates of joins are far too large
    nodes = passed(with_global_rank(nodes, ["node"], "nid", ranges).select("node", "nid"))
    number = lambda c: nodes.select(F.col("node").alias(c), F.col("nid").alias(f"n{c}"))
    numbers = passed(pairs.where("a <> b").join(number("a"), "a").select("na", "b"))
    return nodes, passed(numbers.join(number("b"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b")))


def dealt_by(df: DataFrame, key: str, rows: int) -> tuple[DataFrame, int]:
    """``df`` kept by hash of ``key``, so that joins and groupings on it move only their other side, and the
    number of partitions.  To be unpersisted."""
    from pyspark import StorageLevel
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, rows >> 21)
    return df.repartition(parts, key).persist(StorageLevel.MEMORY_AND_DISK), parts


# ----------------------------------------------------------------------------- PageRank

def pagerank(edges: DataFrame, alpha: float = 0.85, max_iter: int = 100, tol: float = 1e-6,
             weighted: bool = True, extra_nodes: DataFrame | None = None,
             checkpoint_interval: int = 1) -> DataFrame:
    """Weighted PageRank with uniform teleport and uniform dangling mass.

    rank'(v) = (1-a)/n + a * dangling/n + a * sum_{u->v} rank(u) w(u,v)/out_w(u).
    Stops when sum |rank' - rank| < tol and then returns the *previous* iterate (as the
    reference does); otherwise the last one after ``max_iter`` rounds."""
    spark = edges.sparkSession
    pairs = cut_lineage(weighted_pairs(edges, weighted))
    outw = pairs.groupBy("src").agg(F.sum("w").alias("_ow"))
    trans = cut_lineage(pairs.join(outw, "src").select("src", "dst", (F.col("w") / F.col("_ow")).alias("p")))
    nodes = cut_lineage(node_table(edges, extra_nodes))
    n = nodes.count()
    if n == 0:
        return spark.createDataFrame([], "node string, pagerank double")
    dang_nodes = nodes.join(outw.select(F.col("src").alias("node")), "node", "left_anti")
    rank = cut_lineage(nodes.withColumn("rank", F.lit(1.0 / n)))
    state = IterationState(checkpoint_interval)
    for _ in range(max_iter):
        contrib = trans.join(rank.select(F.col("node").alias("src"), "rank"), "src") \
            .groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("p")).alias("_c"))
        dang = dang_nodes.join(rank, "node").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("_d"))
        new = (nodes.join(contrib, "node", "left").crossJoin(F.broadcast(dang))
               .select("node", (F.lit((1 - alpha) / n) + F.lit(alpha / n) * F.col("_d")
                                + F.lit(alpha) * F.coalesce(F.col("_c"), F.lit(0.0))).alias("rank")))
        new = state.keep(new)
        diff = new.join(rank.withColumnRenamed("rank", "_old"), "node") \
            .agg(F.sum(F.abs(F.col("rank") - F.col("_old")))).first()[0]
        if diff < tol:
            break
        rank = new
    return rank.withColumnRenamed("rank", "pagerank")


# ----------------------------------------------------------------------------- eigenvector

def eigenvector_centrality(edges: DataFrame, max_iter: int = 100, tol: float = 1e-6,
                           weighted: bool = False, checkpoint_interval: int = 1) -> DataFrame:
    """Power iteration x' = M x / |M x| with M[src, dst] = summed weight, x0 = 1/sqrt(n).

    Nodes are inferred from the edges (D4).  Stops when |x' - x| < tol (returns x, the previous
    iterate) or when |M x| = 0 (returns x).  One aggregate per round gives |y|^2, y.x and |x|^2,
    so |y/|y| - x|^2 = 1 - 2 y.x/|y| + |x|^2 needs no second pass."""
    spark = edges.sparkSession
    pairs = cut_lineage(weighted_pairs(edges, weighted))
    nodes = cut_lineage(node_table(edges))
    n = nodes.count()
    if n == 0:
        return spark.createDataFrame([], "node string, eigenvector double")
    x = cut_lineage(nodes.withColumn("x", F.lit(1.0 / n ** 0.5)))
    state = IterationState(checkpoint_interval)
    for _ in range(max_iter):
        y = pairs.join(x.select(F.col("node").alias("dst"), "x"), "dst") \
            .groupBy(F.col("src").alias("node")).agg(F.sum(F.col("w") * F.col("x")).alias("y"))
        y = state.keep(nodes.join(y, "node", "left").fillna({"y": 0.0}))
        s = y.join(x, "node").agg(F.sum(F.col("y") * F.col("y")).alias("yy"), F.sum(F.col("y") * F.col("x")).alias("yx"),
                                  F.sum(F.col("x") * F.col("x")).alias("xx")).first()
        norm = s["yy"] ** 0.5
        if norm == 0:
            break
        d2 = max(1.0 - 2.0 * s["yx"] / norm + s["xx"], 0.0)
        new = y.select("node", (F.col("y") / F.lit(norm)).alias("x"))
        if d2 ** 0.5 < tol:
            break
        x = new
    return x.withColumnRenamed("x", "eigenvector")


# ----------------------------------------------------------------------------- BFS family

def bfs_levels(adj: DataFrame, sources: DataFrame, max_depth: int | None = None,
               symmetric: bool = False) -> DataFrame:
    """Level-synchronous multi-source BFS: (source, node, dist, sigma) with sigma = number of
    shortest paths.  ``adj(u, v)`` is the adjacency; ``sources(node)``.

    Each level: frontier x adj, sum sigma per (source, node), anti join the nodes already
    placed; the level is checkpointed once and the visited set is the union of the level
    tables (never rewritten).  With a symmetric (undirected) adjacency a node reached from
    level d lies at distance d-1, d or d+1, so only the last two levels are excluded.
    Stops when a level is empty (one emptiness check per level)."""
    frontier = cut_lineage(sources.select(F.col("node").alias("source"), F.col("node"),
                                          F.lit(0).alias("dist"), F.lit(1.0).alias("sigma")))
    levels = [frontier]
    d = 0
    while max_depth is None or d < max_depth:
        cand = (frontier.join(adj.withColumnRenamed("u", "node"), "node")
                .groupBy("source", F.col("v").alias("node")).agg(F.sum("sigma").alias("sigma")))
        done = levels[-2:] if symmetric else levels
        seen = done[0].select("source", "node")
        for lv in done[1:]:
            seen = seen.unionByName(lv.select("source", "node"))
        nxt = cand.join(seen, ["source", "node"], "left_anti").withColumn("dist", F.lit(d + 1))
        nxt = cut_lineage(nxt.select("source", "node", "dist", "sigma"))
        if nxt.isEmpty():
            break
        levels.append(nxt)
        frontier = nxt
        d += 1
    out = levels[0]
    for lv in levels[1:]:
        out = out.unionByName(lv)
    return out


def _sources(nodes: DataFrame, sample_size: int | None, seed: int = 42) -> DataFrame:
    """All nodes, or the ``sample_size`` nodes with the smallest hash of (node, seed) (a
    deterministic sample, chosen by a distributed top-k)."""
    if sample_size is None:
        return nodes
    return nodes.orderBy(draw60(F.col("node"), F.lit(seed)), "node").limit(sample_size)


def closeness_centrality(edges: DataFrame, disconnected: bool = False,
                         sample_size: int | None = None) -> DataFrame:
    """(N-1)/sum(d) when the node reaches all N nodes, else 0; with ``disconnected``
    (reachable-1)/sum(d).  Undirected, unweighted; nodes reaching only themselves -> 0.

    Bit-parallel breadth-first search from all nodes, or from ``sample_size`` hash-chosen ones
    (then only those get a value)."""
    names, pairs = numbered_graph(edges)
    known = names if sample_size is None else cut_lineage(_sources(names, sample_size).select("node", "nid"))
    return _closeness_of(names, pairs, known, known.select(F.col("nid").alias("node")), names.count(), disconnected)


def _tiled(components: DataFrame, pairs: DataFrame, n_nodes: int, tile: int) -> tuple[DataFrame, DataFrame] | None:
    """(numbered nodes, edge tiles) if the tiles hold enough edges to pay; ``pairs`` has each pair once."""
    from ..plans.ordering import with_global_rank
    numbered = cut_lineage(with_global_rank(components, ["component", "node"], "nid").select("node", "nid"))
    packed = tiles.edge_tiles(pairs, numbered, tile)
    return (numbered, packed) if tiles.tiles_are_full(packed, n_nodes, tile) else None


def _source_rounds(sources: DataFrame, numbered: DataFrame, lanes: int, groups: int):
    """(sid, nid) of the sources, numbered in the order of the nodes, ``groups`` groups of lanes at a time."""
    from ..plans.ordering import with_global_rank
    s = cut_lineage(with_global_rank(sources.select("node").join(numbered, "node").select("nid"), ["nid"], "sid"))
    for first in range(0, s.count(), lanes * groups):
        yield s.where((F.col("sid") >= first) & (F.col("sid") < first + lanes * groups))


LANES = 16               # sources whose state shares a row, one column each
TILE_LANES = 128         # sources of a group over tiles
TILE_WORDS = 64          # words of 64 sources of a group over tiles of bits
STATE_ROWS = 1 << 22     # rows of state of a round of source blocks
LOCAL_PAIRS = 1 << 22    # pairs of a component that a task holds


def source_blocks(sources: DataFrame, n_nodes: int, lanes: int, state_rows: int):
    """Sources numbered in node order, cut into blocks of ``lanes``, and rounds of as many blocks
    as give at most ``state_rows`` rows (block, node): (node, block, lane) tables, one per round."""
    from ..plans.ordering import with_global_rank
    ranges = max(sources.sparkSession.sparkContext.defaultParallelism, n_nodes >> 20)   # estimates of joins are far too large
    numbered = cut_lineage(with_global_rank(sources.select("node"), ["node"], "sid", ranges))
    blocks = -(-numbered.count() // lanes)
    per_round = max(1, state_rows // max(1, n_nodes))
    placed = numbered.select("node", F.floor(F.col("sid") / lanes).cast("long").alias("block"),
                             F.pmod("sid", F.lit(lanes)).cast("int").alias("lane"))
    for first in range(0, blocks, per_round):
        yield placed.where((F.col("block") >= first) & (F.col("block") < first + per_round))


def _lane_levels(adj: DataFrame, sources: DataFrame, lanes: list[str]) -> list[DataFrame]:
    """Forward pass of a round: per distance (block, node, a path count per lane); a lane is 0 where
    the node is not at that distance from the lane's source, ``at`` has the bits of the others.

    The graph is undirected, so what a level reaches lies one level back, on it, or one further:
    only the bits of the last two levels are kept out."""
    level = cut_lineage(sources.groupBy("block", "node").agg(
        *[F.max(F.when(F.col("lane") == i, 1.0).otherwise(0.0)).alias(c) for i, c in enumerate(lanes)],
        F.bit_or(F.expr("shiftleft(1, lane)")).alias("at")))
    levels = [level]
    while True:
        reached = (levels[-1].drop("at").join(adj.withColumnRenamed("u", "node"), "node")
                   .groupBy("block", F.col("v").alias("node")).agg(*[F.sum(c).alias(c) for c in lanes]))
        seen = levels[-1].select("block", "node", "at")
        if len(levels) > 1:
            seen = seen.unionByName(levels[-2].select("block", "node", "at")).groupBy("block", "node").agg(
                F.bit_or("at").alias("at"))
        fresh = lambda i, c: F.when((F.col("_seen").isNull() | (F.getbit("_seen", F.lit(i)) == 0)) & (F.col(c) > 0),
                                    F.col(c)).otherwise(0.0)
        new = reached.join(seen.withColumnRenamed("at", "_seen"), ["block", "node"], "left").select(
            "block", "node", *[fresh(i, c).alias(c) for i, c in enumerate(lanes)])
        bits = sum((F.when(F.col(c) > 0, F.lit(1 << i)).otherwise(0) for i, c in enumerate(lanes)), F.lit(0))
        new = cut_lineage(new.withColumn("at", bits).where("at <> 0"))
        if new.isEmpty():
            return levels
        levels.append(new)


def _lane_dependencies(adj: DataFrame, levels: list[DataFrame], lanes: list[str]) -> DataFrame:
    """Backward pass of a round: (node, delta), the sum of the lanes' dependencies on a node."""
    below, parts = None, None       # (block, node, delta per lane) of the level after the current one
    for d in range(len(levels) - 2, 0, -1):
        child = levels[d + 1].drop("at")
        if below is not None:
            child = child.join(below.select("block", "node", *[F.col(c).alias(f"_{c}") for c in lanes]), ["block", "node"], "left")
        share = lambda c: F.when(F.col(c) > 0, (1 + (F.coalesce(F.col(f"_{c}"), F.lit(0.0)) if below is not None else F.lit(0.0)))
                                 / F.col(c)).otherwise(0.0)
        shares = child.select("block", "node", *[share(c).alias(c) for c in lanes])
        # (1 + delta) / paths summed over the neighbours one level on, then one join with the level
        got = (shares.join(adj.withColumnRenamed("u", "node"), "node")
               .groupBy("block", F.col("v").alias("node")).agg(*[F.sum(c).alias(f"_{c}") for c in lanes]))
        below = cut_lineage(levels[d].drop("at").join(got, ["block", "node"], "left").select(
            "block", "node", *[(F.col(c) * F.coalesce(F.col(f"_{c}"), F.lit(0.0))).alias(c) for c in lanes]))
        part = below.groupBy("node").agg(F.sum(sum((F.col(c) for c in lanes[1:]), F.col(lanes[0]))).alias("delta"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def betweenness_centrality(edges: DataFrame, normalized: bool = True, sample_size: int | None = None,
                           lanes: int | None = None, state_rows: int = STATE_ROWS, tile: int = tiles.TILE,
                           local_pairs: int = LOCAL_PAIRS) -> DataFrame:
    """R2: Brandes betweenness on the undirected distinct graph, summed over sources in both
    directions and scaled by 2/((n-1)(n-2)) when normalised (star centre = 2.0, as the reference).

    Components of at most ``local_pairs`` pairs run inside tasks, each with a share of the sources
    (:mod:`.inside`).  In the others sources run in groups of ``lanes``, as columns of matrices over
    ranges of ``tile`` nodes (:mod:`.tiles`), or, where the tiles of the adjacency are nearly empty, of
    one row per (block, node); as many groups at a time as keep the state at ``state_rows`` rows of
    nodes; per round one forward and one backward pass, whose dependencies are added to one sum per
    node.  At no time is there a table of all (source, node) pairs, however large the graph; the rounds
    grow instead."""
    names, pairs = numbered_graph(edges)
    n = names.count()
    nodes = names.select(F.col("nid").alias("node"))
    chosen = nodes if sample_size is None else cut_lineage(_sources(names, sample_size).select(F.col("nid").alias("node")))
    total = None
    if n:
        of = cut_lineage(_numbered_components(nodes, pairs))
        inside = Inside(of, pairs, chosen, local_pairs)
        total = inside.dependencies()
        rest = _large_components(of, pairs, chosen, inside.large)
        if rest:
            part = _distributed_dependencies(*rest, lanes, state_rows, tile)
            if part is not None:
                total = part if total is None else total.unionByName(part)
    if total is None:
        out = names.select("node", F.lit(0.0).alias("betweenness"))
    else:
        total = total.select(F.col("node").alias("nid"), F.col("delta").alias("betweenness"))
        out = names.join(total, "nid", "left").select("node", "betweenness").fillna({"betweenness": 0.0})
    if normalized and n > 2:
        out = out.withColumn("betweenness", F.col("betweenness") * F.lit(2.0 / ((n - 1) * (n - 2))))
    return out


def _large_components(of: DataFrame, pairs: DataFrame, sources: DataFrame, large: DataFrame):
    """(of, pairs, sources) in the components ``large(component)``, or none."""
    if large.isEmpty():
        return None
    of = cut_lineage(of.join(large, "component", "left_semi").select("node", "component"))
    held = stored(pairs.join(of.select(F.col("node").alias("a")), "a", "left_semi").select("a", "b"))
    return of, held, cut_lineage(sources.join(of.select("node"), "node", "left_semi"))


def _distributed_dependencies(of: DataFrame, pairs: DataFrame, chosen: DataFrame, lanes: int | None, state_rows: int,
                              tile: int) -> DataFrame | None:
    """(node, delta) over components that no task holds."""
    n = of.count()
    tiled = _tiled(of, pairs, n, tile)
    if tiled:
        numbered, packed = tiled
        width = lanes or max(8, min(TILE_LANES, (1 << 25) // n))
        rounds = (tiles.dependencies(packed, s, width, tile)
                  for s in _source_rounds(chosen, numbered, width, max(1, state_rows // n)))
    else:
        adj = cut_lineage(mirrored(pairs))
        columns = [f"s{i}" for i in range(lanes or LANES)]
        rounds = (_lane_dependencies(adj, _lane_levels(adj, s, columns), columns)
                  for s in source_blocks(chosen, n, len(columns), state_rows))
    key = "nid" if tiled else "node"
    total = None
    for part in rounds:
        if part is not None:
            both = part if total is None else total.unionByName(part)
            total = cut_lineage(both.groupBy(key).agg(F.sum("delta").alias("delta")))
    if tiled and total is not None:
        total = total.join(numbered, "nid").select("node", "delta")
    return total


def shortest_path_lengths(edges: DataFrame, sources: DataFrame, directed: bool = False,
                          max_depth: int | None = None) -> DataFrame:
    """Hop distances from each given source (``sources(node)``) to every reachable node."""
    if directed:
        e = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
        adj = e.select(F.col("src").alias("u"), F.col("dst").alias("v")).distinct()
    else:
        adj = undirected_adjacency(edges)
    adj = stored(adj)
    adj, _ = dealt_by(adj, "u", adj.count())      # levels join it on u: only the frontier moves
    levels = bfs_levels(adj, sources, max_depth, symmetric=not directed).select("source", "node", "dist")
    adj.unpersist()
    return levels


# ----------------------------------------------------------------------------- triangles

def numbered_by_degree(edges: DataFrame) -> DataFrame:
    """nodes(node, nid): nodes with a neighbour, numbered by (distinct neighbours, id)."""
    from ..plans.ordering import with_global_rank
    deg = stored(undirected_adjacency(edges).groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("deg")))
    ranges = max(edges.sparkSession.sparkContext.defaultParallelism, deg.count() >> 20)
    return stored(with_global_rank(deg, ["deg", "node"], "nid", ranges).select("node", "nid"))


def with_numbers(pairs: DataFrame, nodes: DataFrame, *ends: str) -> DataFrame:
    """The two ``ends`` of pairs by the numbers of nodes(node, nid)."""
    for c in ends:
        pairs = pairs.join(nodes.select(F.col("node").alias(c), F.col("nid").alias(f"_{c}")), c)
    return pairs.select(*[F.col(f"_{c}").alias(c) for c in ends])


def with_names(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every column of numbers by the nodes they stand for."""
    for c in rows.columns:
        rows = rows.join(nodes.select(F.col("nid").alias(c), F.col("node").alias(f"_{c}")), c).drop(c)
    return rows.select(*[F.col(c).alias(c[1:]) for c in rows.columns])


def oriented_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, oriented): each undirected distinct pair (u, v) oriented from lower to higher (degree, id),
    by the numbers of the nodes in that order, so every node keeps at most sqrt(2m) out-neighbours."""
    pairs = stored(undirected_pairs(edges).where("a <> b"))
    nodes = numbered_by_degree(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    o = with_numbers(pairs, nodes, "a", "b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    return nodes, stored(o)


def _common(o: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lists(u, out), common(a, b, m)): out-neighbours, and those that both ends of an oriented edge have.
    What moves is a list per edge, not a row per pair of edges of a node."""
    lists = o.groupBy("u").agg(F.collect_list("v").alias("out"))
    of_b = o.join(lists.select(F.col("u").alias("v"), F.col("out").alias("_b")), "v")
    both = of_b.join(lists.select("u", F.col("out").alias("_a")), "u").select(
        F.col("u").alias("a"), F.col("v").alias("b"), F.array_intersect("_a", "_b").alias("m"))
    return lists, both.where(F.size("m") > 0)


def triangles(edges: DataFrame, names: bool = True) -> DataFrame:
    """N7 (size 3): each triangle once as (a, b, c), found at its lowest-ordered vertex; without ``names`` by
    the numbers of the nodes."""
    nodes, o = oriented_edges(edges)
    t = _common(o)[1].select("a", "b", F.explode("m").alias("c"))
    return with_names(t, nodes) if names else t


def four_cliques(edges: DataFrame, names: bool = True) -> DataFrame:
    """N7 (size 4): triangles (a, b, c) extended by d with a->d, b->d, c->d oriented edges."""
    nodes, o = oriented_edges(edges)
    lists, common = _common(o)
    t = common.where(F.size("m") > 1).select("a", "b", "m", F.explode("m").alias("c"))
    q = t.join(lists.select(F.col("u").alias("c"), "out"), "c").select(
        "a", "b", "c", F.explode(F.array_intersect("m", "out")).alias("d"))
    return with_names(q, nodes) if names else q


def clustering_coefficient(edges: DataFrame) -> DataFrame:
    """2 e(v) / (k (k - 1)) on the undirected distinct graph, k < 2 -> 0.

    A node with a self-loop is its own neighbour: it counts in k, and forms a pair with each of
    its other neighbours, so e(v) = triangles(v) + others(v) if v has a loop."""
    t = triangles(edges)
    per = t.select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("_t"))
    deg = undirected_adjacency(edges).groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("_o"))
    loops = edges.where(F.col("src") == F.col("dst")).select(F.col("src").alias("node"), F.lit(1).alias("_l")).distinct()
    x = node_table(edges)
    for part in (deg, per, loops):
        x = x.join(part, "node", "left")
    x = x.fillna({"_o": 0, "_t": 0, "_l": 0}).withColumn("_k", F.col("_o") + F.col("_l"))
    return x.select("node", F.when(F.col("_k") < 2, F.lit(0.0)).otherwise(
        2.0 * (F.col("_t") + F.col("_l") * F.col("_o")) / (F.col("_k") * (F.col("_k") - 1))).alias("clustering"))


# ----------------------------------------------------------------------------- components

def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("a").agg(F.min("b").alias("m"))
    down = e.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def star_components(pairs: DataFrame, keep=cut_lineage) -> DataFrame:
    """pairs(a, b) -> (node, root) with the smallest node of each component as root.

    Large-star and small-star steps in turn: the neighbours of a node are tied to the smallest of
    them.  The rounds grow with the logarithm of the number of nodes, not with the diameter;
    each is a grouped minimum and a join, written by ``keep`` (a reliable checkpoint).  Runs until
    the edge set (its count and a hash of its rows) no longer changes."""
    e = pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    return _stars(keep(e), keep)


def _stars(e: DataFrame, keep) -> DataFrame:
    """The rounds, over distinct (a, b) with a > b; ``keep`` writes what a round leaves."""
    seen = None
    while True:
        mark = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if mark["n"] == 0 or mark == seen:
            break
        seen = mark
        e = keep(_small_star(_large_star(e)))
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def weak_components(edges: DataFrame) -> DataFrame:
    """Weakly connected components, labelled by their smallest node id."""
    nodes, pairs = numbered_graph(edges)
    of = _numbered_components(nodes.select(F.col("nid").alias("node")), pairs).withColumnRenamed("node", "nid")
    names = nodes.select(F.col("nid").alias("component"), F.col("node").alias("_name"))
    return nodes.join(of, "nid").join(names, "component").select("node", F.col("_name").alias("component"))


def _numbered_components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, component), smallest number as label, of nodes(node) and distinct pairs(a, b), a < b.

    Every node is tied to its smallest neighbour first: these ties, fewer than nodes, join most of a
    component, and the rounds over them move nodes, not pairs.  Of the pairs only those between two of
    the trees are left, each two trees once; they meet the labels in two joins."""
    ties = pairs.groupBy("a").agg(F.min("b").alias("b")).unionByName(
        pairs.groupBy(F.col("b").alias("a")).agg(F.min("a").alias("b")))
    ties = ties.groupBy("a").agg(F.min("b").alias("b"))
    trees = passed(_stars(passed(_downwards(ties)), passed))
    tree = lambda c: trees.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    half = passed(pairs.join(tree("a"), "a").select("ra", "b"))
    half = half.join(tree("b"), "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    roots = passed(_stars(passed(_downwards(half)), passed).select(F.col("node").alias("root"), F.col("root").alias("top")))
    of = trees.join(roots, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return nodes.join(of, "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def _downwards(ties: DataFrame) -> DataFrame:
    """Each tie once, from the larger to the smaller."""
    return ties.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """Synchronous label propagation on the undirected distinct graph: every node takes
    the most frequent label among its neighbours, ties to the smallest label; isolated nodes
    keep theirs.  Fixed number of rounds.

    Nodes and labels are numbers in the order of the nodes.  The adjacency stays where its first end
    is; a round moves each label once per neighbour, to that neighbour, where it is counted."""
    nodes, pairs = numbered_graph(edges)
    adj, parts = dealt_by(mirrored(pairs), "u", 2 * pairs.count())
    lab = nodes.select(F.col("nid").alias("u"), F.col("nid").alias("label"))
    state = IterationState(1)
    low = (1 << 32) - 1
    small = nodes.count() < 1 << 31       # then a count and a label share a number: most, then smallest, is its maximum
    for _ in range(rounds):
        sent = adj.join(lab, "u").select(F.col("v").alias("u"), "label").repartition(parts, "u")
        counts = sent.groupBy("u", "label").agg(F.count(F.lit(1)).alias("_c"))
        if small:
            top = F.max(F.shiftleft("_c", 32) + (F.lit(low) - F.col("label")))
            best = counts.groupBy("u").agg(top.alias("_t")).select("u", (F.lit(low) - F.col("_t").bitwiseAND(F.lit(low))).alias("_best"))
        else:
            best = counts.groupBy("u").agg(F.min_by("label", F.struct((-F.col("_c")).alias("nc"), F.col("label"))).alias("_best"))
        lab = state.keep(lab.join(best, "u", "left").select("u", F.coalesce("_best", "label").alias("label")))
    adj.unpersist()
    names = nodes.select(F.col("nid").alias("label"), F.col("node").alias("_name"))
    return nodes.select("node", F.col("nid").alias("u")).join(lab, "u").join(names, "label").select("node", F.col("_name").alias("label"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Q = sum_c [L_c/m - (d_c/2m)^2] on the undirected distinct graph."""
    adj = cut_lineage(undirected_adjacency(edges))
    m = adj.count() / 2.0
    of_u = labels.select(F.col("node").alias("u"), "label")
    of_v = labels.groupBy(F.col("node").alias("v")).agg(F.collect_list("label").alias("_lv"))
    # one pass over the adjacency: per label its edge ends and those that stay inside
    inside = F.coalesce(F.size(F.filter("_lv", lambda c: c == F.col("label"))), F.lit(0))
    x = adj.join(of_u, "u").join(of_v, "v", "left").groupBy("label").agg(
        F.count(F.lit(1)).alias("_d"), (F.sum(F.when(F.col("_lv").isNotNull(), inside).otherwise(0)) / 2.0).alias("_L"))
    return x.agg(F.sum(F.col("_L") / m - (F.col("_d") / (2 * m)) ** 2).alias("modularity"))


def community_summary(labels: DataFrame, top: int = 5) -> DataFrame:
    """Community sizes with rank (largest first, 1-based); ``rank <= top`` gives the top
    list.  The number of communities can approach the number of nodes, so the rank is the
    range-partitioned global rank, not a single-partition window."""
    from ..plans.ordering import with_global_rank
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    r = with_global_rank(sizes.withColumn("_ns", -F.col("size")), ["_ns", "label"], "_r")
    return r.select("label", "size", (F.col("_r") + 1).alias("rank"))


# ----------------------------------------------------------------------------- cycles

def cycle_edges(edges: DataFrame, max_cycle: int = 4) -> DataFrame:
    """Distinct (src, dst) that lie on a directed cycle of 2 to ``max_cycle`` (at most 4) nodes.

    Cycles are put together from halves that meet in the middle.  Nodes are ordered by (number of
    neighbours, id); the halves of a cycle of 3 or 4 begin or end at its highest node, so a half
    a -> b -> c passes only nodes below a, and there are at most as many halves as edges times the
    square root of edges, also around hubs.  A cycle of 3 closes a half by an edge, a cycle of 4 is two
    halves with the same ends; every half goes to its ends once, and never (head, node) pairs.  Nodes
    are numbers in that order."""
    if max_cycle not in (2, 3, 4):
        raise ValueError("cycles of 2, 3 or 4 nodes")
    e = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
    e = stored(e.select("src", "dst").distinct())
    nodes = numbered_by_degree(e)
    e = stored(with_numbers(e, nodes, "src", "dst"))
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    out = e.join(back, ["src", "dst"], "left_semi")
    if max_cycle > 2:
        first = e.where("dst < src").select(F.col("src").alias("a"), F.col("dst").alias("b")).join(
            e.select(F.col("src").alias("b"), F.col("dst").alias("c")), "b").where("c < a")          # a -> b -> c below a
        ends = first.select("a", "c", "b").repartition("a", "c").groupBy("a", "c").agg(F.collect_list("b").alias("b"))
        ends = ends.join(e.select(F.col("src").alias("c"), F.col("dst").alias("a"), F.lit(True).alias("closes")), ["a", "c"], "left")
        edge = lambda x, y: F.struct(x.alias("src"), y.alias("dst"))
        a, c = F.col("a"), F.col("c")
        on = [F.flatten(F.transform("b", lambda b: F.array(edge(a, b), edge(b, c)))), F.when(F.col("closes"), F.array(edge(c, a)))]
        if max_cycle > 3:
            last = e.where("src < dst").select(F.col("src").alias("d"), F.col("dst").alias("a")).join(
                e.select(F.col("src").alias("c"), F.col("dst").alias("d")), "d").where("c < a")       # c -> d -> a below a
            last = last.select("a", "c", "d").repartition("a", "c").groupBy("a", "c").agg(F.collect_list("d").alias("d"))
            ends = ends.join(last, ["a", "c"], "left").where("closes or d is not null")
            on.append(F.flatten(F.transform("d", lambda d: F.array(edge(c, d), edge(d, a)))))
        else:
            ends = ends.where("closes")
        on = F.concat(*[F.coalesce(x, F.array().cast("array<struct<src:bigint,dst:bigint>>")) for x in on])
        out = out.unionByName(ends.select(F.explode(on).alias("e")).select("e.*"))
    return with_names(out.distinct(), nodes)


def cyclic_flow_ratio(edges: DataFrame, max_cycle: int = 4) -> DataFrame:
    """G22 (decision: bounded cycles): share of volume on edges that lie on a directed cycle of at most
    ``max_cycle`` nodes."""
    e = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
    on = cycle_edges(edges, max_cycle).withColumn("_on", F.lit(True))
    volume = F.abs("amount")
    return e.join(on, ["src", "dst"], "left").agg(F.coalesce(
        F.sum(F.when(F.col("_on"), volume)) / F.sum(volume), F.lit(0.0)).alias("cyclic_flow_ratio"))


def importance_metrics(edges: DataFrame, sample_size: int | None = None) -> DataFrame:
    """Degree, betweenness, closeness, PageRank, clustering, eigenvector per node, 0-filled."""
    from .features import degree_centrality
    nodes = node_table(edges, drop_null_edges=False)
    parts = [degree_centrality(edges), betweenness_centrality(edges, sample_size=sample_size),
             closeness_centrality(edges, sample_size=sample_size), pagerank(edges),
             clustering_coefficient(edges), eigenvector_centrality(edges)]
    out = nodes
    for p in parts:
        out = out.join(p, "node", "left")
    return out.fillna(0.0)


def closeness_bitset(edges: DataFrame, disconnected: bool, nodes: DataFrame, sources: DataFrame,
                     state_rows: int = STATE_ROWS, tile: int = tiles.TILE, local_pairs: int = LOCAL_PAIRS) -> DataFrame:
    """R3 by bit-parallel multi-source BFS: inside tasks for components of at most ``local_pairs`` pairs
    (:mod:`.inside`), in the others by matrices of bits over ranges of ``tile`` nodes (:mod:`.tiles`), or,
    where the tiles of the adjacency are nearly empty, one word of 64 sources per row, as follows.

    Sources get a word and a bit.  State rows are (node, word, bits): ``visited`` has the bit of
    every source that reached the node, ``frontier`` the bits first reached at the current level.
    One level = frontier x adjacency -> ``bit_or`` per (node, word) -> drop already-visited bits: it
    moves edges x words instead of (source, node) pairs x degree.  Distance sums per source come
    from the newly set bits of each level.  As many words run at a time as keep the state at
    ``state_rows`` rows, so there is never a row for every node and word of a large graph."""
    names, pairs = numbered_graph(edges)
    n_all = nodes.count()
    known = sources.select("node").join(names, "node", "left").select("node", "nid")
    chosen = known.where("nid is not null").select(F.col("nid").alias("node"))
    return _closeness_of(names, pairs, known, chosen, n_all, disconnected, state_rows, tile, local_pairs)


def _closeness_of(names: DataFrame, pairs: DataFrame, known: DataFrame, chosen: DataFrame, n_all: int, disconnected: bool,
                  state_rows: int = STATE_ROWS, tile: int = tiles.TILE, local_pairs: int = LOCAL_PAIRS) -> DataFrame:
    """Closeness of the sources ``known(node, nid)``, ``chosen(node)`` by numbers."""
    of = cut_lineage(_numbered_components(names.select(F.col("nid").alias("node")), pairs))
    inside = Inside(of, pairs, chosen, local_pairs)
    parts = [] if (got := inside.distances()) is None else [got.select(
        F.col("node").alias("nid"), _closeness(n_all, disconnected).alias("closeness"))]
    rest = _large_components(of, pairs, chosen, inside.large)
    if rest:
        parts += _distributed_closeness(*rest, n_all, disconnected, state_rows, tile)
    if not parts:
        return known.select("node", F.lit(0.0).alias("closeness"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return known.join(out, "nid", "left").select("node", "closeness").fillna({"closeness": 0.0})


def _distributed_closeness(of: DataFrame, pairs: DataFrame, sources: DataFrame, n_all: int, disconnected: bool,
                           state_rows: int, tile: int) -> list[DataFrame]:
    """(nid, closeness) of the sources in components that no task holds."""
    n = of.count()
    tiled = _tiled(of, pairs, n, tile)
    if tiled:
        return [_closeness_tiled(sources, *tiled, n, n_all, disconnected, state_rows, tile).select(F.col("node").alias("nid"), "closeness")]
    adj = cut_lineage(mirrored(pairs))
    rounds = [cut_lineage(_closeness_round(adj, part, n_all, disconnected)) for part in source_blocks(sources, n, 64, state_rows)]
    return [part.select(F.col("node").alias("nid"), "closeness") for part in rounds]


def _closeness_round(adj: DataFrame, idx: DataFrame, n_all: int, disconnected: bool) -> DataFrame:
    bit = F.expr("shiftleft(cast(1 as bigint), lane)")
    frontier = cut_lineage(idx.groupBy("node", F.col("block").alias("w")).agg(F.bit_or(bit).alias("bits")))
    visited = frontier
    reached = None          # per source of the round: nodes reached and the sum of their distances
    d = 0
    while True:
        cand = (frontier.join(adj.withColumnRenamed("u", "node"), "node")
                .groupBy(F.col("v").alias("node"), "w").agg(F.bit_or("bits").alias("bits")))
        new = (cand.join(visited.withColumnRenamed("bits", "_vb"), ["node", "w"], "left")
               .select("node", "w", (F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce(F.col("_vb"), F.lit(0).cast("long")))))
                       .alias("bits"))
               .where(F.col("bits") != 0))
        new = cut_lineage(new)
        if new.isEmpty():
            break
        d += 1
        level = (new.select("w", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("lane"), "bits")
                 .where(F.expr("(shiftright(bits, lane) & 1) = 1")).groupBy("w", "lane")
                 .agg(F.count(F.lit(1)).alias("_r"), (F.count(F.lit(1)) * d).alias("_t")))
        reached = level if reached is None else reached.unionByName(level)
        visited = cut_lineage(visited.unionByName(new).groupBy("node", "w").agg(F.bit_or("bits").alias("bits")))
        frontier = new
    g = idx.withColumnRenamed("block", "w")
    if reached is None:
        g = g.withColumns({"_r": F.lit(0), "_t": F.lit(0)})
    else:
        g = g.join(reached.groupBy("w", "lane").agg(F.sum("_r").alias("_r"), F.sum("_t").alias("_t")), ["w", "lane"], "left")
    return g.select("node", _closeness(n_all, disconnected).alias("closeness"))


def _closeness(n_all: int, disconnected: bool) -> Column:
    """From the number of other nodes reached (_r) and the sum of their distances (_t)."""
    r = F.coalesce(F.col("_r"), F.lit(0)) + 1          # the source itself
    t = F.coalesce(F.col("_t"), F.lit(0)).cast("double")
    if disconnected:
        return F.when((r > 1) & (t > 0), (r - 1) / t).otherwise(0.0)
    return F.when((r > 1) & (r == n_all) & (t > 0), F.lit(n_all - 1) / t).otherwise(0.0)


def _closeness_tiled(sources: DataFrame, numbered: DataFrame, packed: DataFrame, n: int, n_all: int, disconnected: bool,
                     state_rows: int, tile: int) -> DataFrame:
    words = max(1, min(TILE_WORDS, -(-n // 64), (1 << 25) // n))
    out = None
    for s in _source_rounds(sources, numbered, 64 * words, max(1, state_rows // n)):
        got = tiles.distances(packed, s, 64 * words, tile)
        part = s.withColumns({"_r": F.lit(0), "_t": F.lit(0)}) if got is None else s.join(
            got.select("sid", F.col("r").alias("_r"), F.col("d").alias("_t")), "sid", "left")
        part = cut_lineage(part.select("nid", _closeness(n_all, disconnected).alias("closeness")))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return numbered.select("node", F.lit(0.0).alias("closeness")).where("false")
    return out.join(numbered, "nid").select("node", "closeness")
