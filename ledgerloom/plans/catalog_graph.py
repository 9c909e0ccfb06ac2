"""Registered queries: iterative and structural graph operators.

The DuckDB oracles unroll the iterations as materialised CTEs (PageRank and eigenvector up
to their iteration cap with the same stop rule; BFS levels up to ``_DEPTH``)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import sql_draw60
from ..operators import graph as gr
from ..sources.adapters import acct_edges, trade_edges, with_views
from ..sources.files import stored
from ..sources.tables import read_table
from .registry import register

_DEPTH = 8   # BFS levels unrolled in the oracle; the test graphs have diameter <= 6


def _sql_pagerank(view: str, alpha: float = 0.85, max_iter: int = 100, tol: float = 1e-6) -> list[str]:
    w = "CASE WHEN amount IS NULL OR amount = 0 THEN 1.0 ELSE amount END"
    ctes = [f"pe AS MATERIALIZED (SELECT src, dst, SUM({w}) AS w FROM {view} WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY src, dst)",
            "pn AS MATERIALIZED (SELECT src AS node FROM pe UNION SELECT dst FROM pe)",
            "po AS MATERIALIZED (SELECT src, SUM(w) AS ow FROM pe GROUP BY src)",
            "pt AS MATERIALIZED (SELECT pe.src, pe.dst, pe.w / po.ow AS p FROM pe JOIN po ON pe.src = po.src)",
            "pc AS MATERIALIZED (SELECT COUNT(*) AS n FROM pn)",
            "pr0 AS MATERIALIZED (SELECT node, 1.0 / pc.n AS rank FROM pn, pc)"]
    for i in range(max_iter):
        ctes.append(f"""pr{i + 1} AS MATERIALIZED (SELECT pn.node, (1 - {alpha}) / pc.n + {alpha} * d.dang / pc.n + {alpha} * COALESCE(c.c, 0.0) AS rank
  FROM pn CROSS JOIN pc CROSS JOIN (SELECT COALESCE(SUM(r.rank), 0.0) AS dang FROM pr{i} r WHERE r.node NOT IN (SELECT src FROM po)) d
  LEFT JOIN (SELECT pt.dst, SUM(r.rank * pt.p) AS c FROM pt JOIN pr{i} r ON pt.src = r.node GROUP BY pt.dst) c ON c.dst = pn.node)""")
    diffs = " UNION ALL ".join(
        f"SELECT {i + 1} AS it, SUM(ABS(a.rank - b.rank)) AS diff FROM pr{i + 1} a JOIN pr{i} b ON a.node = b.node"
        for i in range(max_iter))
    ctes.append(f"pd AS MATERIALIZED ({diffs})")
    ctes.append(f"pstop AS (SELECT COALESCE(MIN(it) - 1, {max_iter}) AS k FROM pd WHERE diff < {tol})")
    allr = " UNION ALL ".join(f"SELECT {i} AS it, node, rank FROM pr{i}" for i in range(max_iter + 1))
    ctes.append(f"pagerank AS (SELECT node, rank AS pagerank FROM ({allr}) a WHERE it = (SELECT k FROM pstop))")
    return ctes


@register("pagerank", operators="R1 (alpha .85, <= 100 rounds, L1 tol 1e-6, previous iterate on convergence)",
          sql=with_views("SELECT node, pagerank FROM pagerank", "acct_edges", extra=_sql_pagerank("acct_edges")),
          doubles=["pagerank"])
def q_pagerank(spark, sf_dir):
    return gr.pagerank(acct_edges(spark, sf_dir))


def _sql_eigen(view: str, max_iter: int = 100, tol: float = 1e-6) -> list[str]:
    ctes = [f"ee AS MATERIALIZED (SELECT src, dst, COUNT(*) * 1.0 AS w FROM {view} WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY src, dst)",
            "en AS MATERIALIZED (SELECT src AS node FROM ee UNION SELECT dst FROM ee)",
            "ec AS MATERIALIZED (SELECT COUNT(*) AS n FROM en)",
            "ex0 AS MATERIALIZED (SELECT node, 1.0 / SQRT(ec.n) AS x FROM en, ec)"]
    for i in range(max_iter):
        ctes.append(f"""ey{i + 1} AS MATERIALIZED (SELECT en.node, COALESCE(s.y, 0.0) AS y FROM en LEFT JOIN
  (SELECT ee.src, SUM(ee.w * x.x) AS y FROM ee JOIN ex{i} x ON ee.dst = x.node GROUP BY ee.src) s ON s.src = en.node)""")
        ctes.append(f"""es{i + 1} AS MATERIALIZED (SELECT SQRT(SUM(y * y)) AS nrm FROM ey{i + 1})""")
        ctes.append(f"""ex{i + 1} AS MATERIALIZED (SELECT y.node, CASE WHEN s.nrm > 0 THEN y.y / s.nrm ELSE 0.0 END AS x FROM ey{i + 1} y, es{i + 1} s)""")
    stops = " UNION ALL ".join(
        f"SELECT {i + 1} AS it, (SELECT nrm FROM es{i + 1}) AS nrm, "
        f"(SELECT SQRT(SUM(POW(a.x - b.x, 2))) FROM ex{i + 1} a JOIN ex{i} b ON a.node = b.node) AS diff"
        for i in range(max_iter))
    ctes.append(f"ed AS MATERIALIZED ({stops})")
    ctes.append(f"estop AS (SELECT COALESCE(MIN(it) - 1, {max_iter}) AS k FROM ed WHERE nrm = 0 OR diff < {tol})")
    allx = " UNION ALL ".join(f"SELECT {i} AS it, node, x FROM ex{i}" for i in range(max_iter + 1))
    ctes.append(f"eigen AS (SELECT node, x AS eigenvector FROM ({allx}) a WHERE it = (SELECT k FROM estop))")
    return ctes


@register("eigenvector_centrality", operators="R4 (power iteration, previous iterate on convergence)",
          sql=with_views("SELECT node, eigenvector FROM eigen", "acct_edges", extra=_sql_eigen("acct_edges")),
          doubles=["eigenvector"])
def q_eigen(spark, sf_dir):
    return gr.eigenvector_centrality(acct_edges(spark, sf_dir))


def _sql_bfs(view: str, sources_sql: str | None = None, depth: int = _DEPTH, prefix: str = "b") -> list[str]:
    ctes = [f"{prefix}adj AS MATERIALIZED (SELECT DISTINCT u, v FROM (SELECT src AS u, dst AS v FROM {view} WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst "
            f"UNION ALL SELECT dst, src FROM {view} WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst) a)",
            f"{prefix}nodes AS MATERIALIZED (SELECT u AS node FROM {prefix}adj UNION SELECT v FROM {prefix}adj)",
            f"{prefix}l0 AS MATERIALIZED (SELECT node AS s, node, 1.0 AS sigma FROM {sources_sql or prefix + 'nodes'})",
            f"{prefix}v0 AS MATERIALIZED (SELECT s, node FROM {prefix}l0)"]
    for d in range(depth):
        ctes.append(f"""{prefix}l{d + 1} AS MATERIALIZED (SELECT l.s, a.v AS node, SUM(l.sigma) AS sigma FROM {prefix}l{d} l JOIN {prefix}adj a ON a.u = l.node
  WHERE NOT EXISTS (SELECT 1 FROM {prefix}v{d} x WHERE x.s = l.s AND x.node = a.v) GROUP BY l.s, a.v)""")
        ctes.append(f"{prefix}v{d + 1} AS MATERIALIZED (SELECT s, node FROM {prefix}v{d} UNION ALL SELECT s, node FROM {prefix}l{d + 1})")
    levels = " UNION ALL ".join(f"SELECT s, node, {d} AS dist, sigma FROM {prefix}l{d}" for d in range(depth + 1))
    ctes.append(f"{prefix}lv AS MATERIALIZED ({levels})")
    return ctes


@register("closeness_centrality", operators="R3 (0 unless the node reaches all nodes)",
          sql=with_views("""SELECT s AS node, CASE WHEN COUNT(*) > 1 AND COUNT(*) = (SELECT COUNT(*) FROM bnodes) AND SUM(dist) > 0
  THEN ((SELECT COUNT(*) FROM bnodes) - 1) * 1.0 / SUM(dist) ELSE 0.0 END AS closeness FROM blv GROUP BY s""",
                         "trade_edges", extra=_sql_bfs("trade_edges")),
          doubles=["closeness"])
def q_closeness(spark, sf_dir):
    return gr.closeness_centrality(trade_edges(spark, sf_dir))


@register("closeness_disconnected", operators="R3 (disconnected=True: (reachable-1)/sum d)",
          sql=with_views("""SELECT s AS node, CASE WHEN COUNT(*) > 1 AND SUM(dist) > 0 THEN (COUNT(*) - 1) * 1.0 / SUM(dist) ELSE 0.0 END AS closeness
FROM blv GROUP BY s""", "acct_edges", extra=_sql_bfs("acct_edges")),
          doubles=["closeness"])
def q_closeness_disc(spark, sf_dir):
    return gr.closeness_centrality(acct_edges(spark, sf_dir), disconnected=True)


def _sql_betweenness(depth: int = _DEPTH, prefix: str = "b") -> list[str]:
    ctes = [f"{prefix}dl{depth} AS MATERIALIZED (SELECT s, node, 0.0 AS delta FROM {prefix}l{depth} WHERE false)"]
    for d in range(depth - 1, -1, -1):
        ctes.append(f"""{prefix}dl{d} AS MATERIALIZED (SELECT p.s, p.node, SUM(p.sigma / c.sigma * (1 + COALESCE(dd.delta, 0.0))) AS delta
  FROM {prefix}l{d + 1} c JOIN {prefix}adj a ON a.u = c.node JOIN {prefix}l{d} p ON p.s = c.s AND p.node = a.v
  LEFT JOIN {prefix}dl{d + 1} dd ON dd.s = c.s AND dd.node = c.node GROUP BY p.s, p.node)""")
    alld = " UNION ALL ".join(f"SELECT s, node, delta FROM {prefix}dl{d}" for d in range(depth))
    ctes.append(f"""{prefix}btw AS (SELECT n.node, COALESCE(SUM(x.delta), 0.0) *
  CASE WHEN (SELECT COUNT(*) FROM {prefix}nodes) > 2 THEN 2.0 / (((SELECT COUNT(*) FROM {prefix}nodes) - 1) * ((SELECT COUNT(*) FROM {prefix}nodes) - 2)) ELSE 1.0 END AS betweenness
  FROM {prefix}nodes n LEFT JOIN ({alld}) x ON x.node = n.node AND x.node <> x.s GROUP BY n.node)""")
    return ctes


@register("betweenness_centrality", operators="R2 (Brandes, undirected, reference scale)",
          sql=with_views("SELECT node, betweenness FROM bbtw", "acct_edges",
                         extra=_sql_bfs("acct_edges") + _sql_betweenness()),
          doubles=["betweenness"])
def q_betweenness(spark, sf_dir):
    return gr.betweenness_centrality(acct_edges(spark, sf_dir))


@register("betweenness_trade", operators="R2 (bipartite trade graph, deeper BFS)",
          sql=with_views("SELECT node, betweenness FROM bbtw", "trade_edges",
                         extra=_sql_bfs("trade_edges") + _sql_betweenness()),
          doubles=["betweenness"])
def q_betweenness_trade(spark, sf_dir):
    return gr.betweenness_centrality(trade_edges(spark, sf_dir))


_SAMPLE_SQL = f"""bsrc AS (SELECT node FROM (SELECT src AS node FROM trade_edges UNION SELECT dst FROM trade_edges) n
  ORDER BY {sql_draw60('node', '42')}, node LIMIT 64)"""


@register("betweenness_sampled", operators="R2 (sample_size: 64 hash-chosen sources, no rescale, as the reference)",
          sql=with_views("SELECT node, betweenness FROM bbtw", "trade_edges",
                         extra=[_SAMPLE_SQL] + _sql_bfs("trade_edges", "bsrc") + _sql_betweenness()),
          doubles=["betweenness"])
def q_betweenness_sampled(spark, sf_dir):
    return gr.betweenness_centrality(trade_edges(spark, sf_dir), sample_size=64)


@register("shortest_paths", operators="N6 (hop distances from given sources)",
          sql=with_views("SELECT s AS source, node, CAST(dist AS BIGINT) AS dist FROM blv", "trade_edges",
                         extra=["src3 AS (SELECT node FROM (SELECT src AS node FROM trade_edges UNION SELECT dst FROM trade_edges) n "
                                "WHERE node IN ('c1', 'c2', 's3'))"] + _sql_bfs("trade_edges", "src3")))
def q_shortest(spark, sf_dir):
    e = stored(gr.undirected_pairs(trade_edges(spark, sf_dir))).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    srcs = gr.node_table(e).where(F.col("node").isin("c1", "c2", "s3"))
    return gr.shortest_path_lengths(e, srcs).withColumn("dist", F.col("dist").cast("long"))


_ADJ_SQL = """adj AS (SELECT DISTINCT u, v FROM (SELECT src AS u, dst AS v FROM acct_edges WHERE src <> dst
  UNION ALL SELECT dst, src FROM acct_edges WHERE src <> dst) a)"""


# neighbours as a set that holds the node itself where it has a self-loop
_LOOP_ADJ_SQL = """ladj2 AS (SELECT src AS u, dst AS v FROM acct_edges UNION SELECT dst, src FROM acct_edges)"""
_CLU_SQL = """clu AS (SELECT k.node, CASE WHEN k.k < 2 THEN 0.0 ELSE 2.0 * COALESCE(t.t, 0) / (k.k * (k.k - 1)) END AS clustering
  FROM (SELECT u AS node, COUNT(*) AS k FROM ladj2 GROUP BY u) k
  LEFT JOIN (SELECT a1.u AS node, COUNT(*) AS t FROM ladj2 a1 JOIN ladj2 a2 ON a1.u = a2.u AND a1.v < a2.v
             JOIN ladj2 a3 ON a3.u = a1.v AND a3.v = a2.v GROUP BY a1.u) t ON t.node = k.node)"""


@register("clustering_coefficient", operators="R5 J9 (degree-ordered triangle join)",
          sql=with_views("SELECT node, clustering FROM clu", "acct_edges", extra=[_LOOP_ADJ_SQL, _CLU_SQL]),
          doubles=["clustering"])
def q_clustering(spark, sf_dir):
    return gr.clustering_coefficient(acct_edges(spark, sf_dir))


@register("clique_counts", operators="N7 (triangles and 4-cliques)",
          sql=with_views("""SELECT (SELECT CAST(COUNT(*) AS BIGINT) FROM adj a1 JOIN adj a2 ON a1.u = a2.u AND a1.u < a1.v AND a1.v < a2.v
          JOIN adj a3 ON a3.u = a1.v AND a3.v = a2.v) AS triangles,
  (SELECT CAST(COUNT(*) AS BIGINT) FROM adj a1 JOIN adj a2 ON a1.u = a2.u AND a1.u < a1.v AND a1.v < a2.v
          JOIN adj a3 ON a3.u = a1.v AND a3.v = a2.v
          JOIN adj a4 ON a4.u = a1.u AND a4.v > a2.v JOIN adj a5 ON a5.u = a1.v AND a5.v = a4.v
          JOIN adj a6 ON a6.u = a2.v AND a6.v = a4.v) AS four_cliques""", "acct_edges", extra=[_ADJ_SQL]))
def q_cliques(spark, sf_dir):
    e = stored(acct_edges(spark, sf_dir).select("src", "dst").distinct())
    t = gr.triangles(e, names=False).agg(F.count(F.lit(1)).alias("triangles"))
    q = gr.four_cliques(e, names=False).agg(F.count(F.lit(1)).alias("four_cliques"))
    return t.crossJoin(q)


# the trade graph, and the nations with their regions as further components
_WHOLE_SQL = """trade_all AS (SELECT src, dst, amount FROM trade_edges UNION ALL
  SELECT 'n' || n_nationkey, 'r' || n_regionkey, 1.0 FROM nation)"""
# trades, and refunds from the supplier back to the customer for returned items
_REFUND_SQL = """trade_refunds AS (SELECT 'c' || o_custkey AS src, 's' || l_suppkey AS dst, l_extendedprice AS amount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R' UNION ALL
  SELECT 's' || l_suppkey, 'c' || o_custkey, l_extendedprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE l_returnflag = 'R')"""


def _whole(spark, sf_dir):
    nation = read_table(spark, sf_dir, "nation").select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("src"),
        F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("dst"), F.lit(1.0).alias("amount"))
    return trade_edges(spark, sf_dir).select("src", "dst", F.col("amount").cast("double").alias("amount")).unionByName(nation)


def _refunds(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_extendedprice")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    c, s = F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    back = F.col("l_returnflag") == "R"
    return j.select(F.when(back, s).otherwise(c).alias("src"), F.when(back, c).otherwise(s).alias("dst"),
                    F.col("l_extendedprice").alias("amount"))


@register("weak_components", operators="R7 (large-star / small-star)",
          sql=with_views("""WITH RECURSIVE r(node, comp) AS (
    SELECT node, node FROM (SELECT src AS node FROM trade_all UNION SELECT dst FROM trade_all) n
    UNION SELECT a.v, r.comp FROM r JOIN (SELECT src AS u, dst AS v FROM trade_all UNION SELECT dst, src FROM trade_all) a ON a.u = r.node)
SELECT node, MIN(comp) AS component FROM r GROUP BY node""", "trade_edges", extra=[_WHOLE_SQL])
          .replace("WITH trade_edges AS", "WITH RECURSIVE trade_edges AS", 1).replace(",\nRECURSIVE r(", ",\nr(", 1)
          .replace("WITH RECURSIVE r(", "r(", 1))
def q_components(spark, sf_dir):
    return gr.weak_components(_whole(spark, sf_dir))


def _sql_lpa(rounds: int = 5) -> list[str]:
    ctes = ["ladj AS MATERIALIZED (SELECT DISTINCT u, v FROM (SELECT src AS u, dst AS v FROM trade_all WHERE src <> dst "
            "UNION ALL SELECT dst, src FROM trade_all WHERE src <> dst) a)",
            "lab0 AS MATERIALIZED (SELECT node, node AS label FROM (SELECT u AS node FROM ladj UNION SELECT v FROM ladj) n)"]
    for i in range(rounds):
        ctes.append(f"""lab{i + 1} AS MATERIALIZED (SELECT l.node, COALESCE(b.label, l.label) AS label FROM lab{i} l LEFT JOIN (
  SELECT node, label FROM (SELECT a.v AS node, x.label, ROW_NUMBER() OVER (PARTITION BY a.v ORDER BY COUNT(*) DESC, x.label) AS rn
    FROM ladj a JOIN lab{i} x ON x.node = a.u GROUP BY a.v, x.label) c WHERE rn = 1) b ON b.node = l.node)""")
    return ctes


@register("label_propagation", operators="N5 (synchronous LPA, 5 rounds, ties to smallest label)",
          sql=with_views("SELECT node, label FROM lab5", "trade_edges", extra=[_WHOLE_SQL] + _sql_lpa(5)))
def q_lpa(spark, sf_dir):
    return gr.label_propagation(_whole(spark, sf_dir), 5)


@register("modularity", operators="N5 (modularity of the LPA communities)",
          sql=with_views("""SELECT SUM(lc / m - POW(dc / (2 * m), 2)) AS modularity FROM (
  SELECT l.label, (SELECT COUNT(*) / 2.0 FROM ladj) AS m, COUNT(*) AS dc,
         COALESCE((SELECT COUNT(*) / 2.0 FROM ladj a JOIN lab5 x ON x.node = a.u JOIN lab5 y ON y.node = a.v
                   WHERE x.label = l.label AND y.label = l.label), 0.0) AS lc
  FROM ladj a JOIN lab5 l ON l.node = a.u GROUP BY l.label) t""", "trade_edges", extra=[_WHOLE_SQL] + _sql_lpa(5)),
          doubles=["modularity"])
def q_modularity(spark, sf_dir):
    e = _whole(spark, sf_dir)
    return gr.modularity(e, gr.label_propagation(e, 5))


@register("community_sizes", operators="N5 (sizes, top communities)",
          sql=with_views("""SELECT label, CAST(size AS BIGINT) AS size, CAST(ROW_NUMBER() OVER (ORDER BY size DESC, label) AS BIGINT) AS rank
FROM (SELECT label, COUNT(*) AS size FROM lab5 GROUP BY label) s""", "trade_edges", extra=[_WHOLE_SQL] + _sql_lpa(5)))
def q_communities(spark, sf_dir):
    return gr.community_summary(gr.label_propagation(_whole(spark, sf_dir), 5)).withColumn("rank", F.col("rank").cast("long"))


@register("cyclic_flow_ratio", operators="G22 (volume on edges closing a directed cycle of length <= 4)",
          sql=with_views("""WITH e AS (SELECT * FROM trade_refunds WHERE src <> dst),
a AS (SELECT DISTINCT src AS u, dst AS v FROM e),
h0 AS (SELECT DISTINCT dst AS o, dst AS node FROM e),
h1 AS (SELECT DISTINCT h0.o, a.v AS node FROM h0 JOIN a ON a.u = h0.node),
h2 AS (SELECT DISTINCT h1.o, a.v AS node FROM h1 JOIN a ON a.u = h1.node),
h3 AS (SELECT DISTINCT h2.o, a.v AS node FROM h2 JOIN a ON a.u = h2.node),
r AS (SELECT * FROM h0 UNION SELECT * FROM h1 UNION SELECT * FROM h2 UNION SELECT * FROM h3)
SELECT COALESCE((SELECT SUM(ABS(amount)) FROM e WHERE EXISTS (SELECT 1 FROM r WHERE r.o = e.dst AND r.node = e.src))
       / (SELECT SUM(ABS(amount)) FROM e), 0.0) AS cyclic_flow_ratio""", extra=[_REFUND_SQL]),
          doubles=["cyclic_flow_ratio"])
def q_cyclic(spark, sf_dir):
    return gr.cyclic_flow_ratio(_refunds(spark, sf_dir))


@register("cyclic_flow_ratio_acct", operators="G22 (dense account graph)",
          sql=with_views("""WITH e AS (SELECT * FROM acct_edges WHERE src <> dst),
a AS (SELECT DISTINCT src AS u, dst AS v FROM e),
h0 AS (SELECT DISTINCT dst AS o, dst AS node FROM e),
h1 AS (SELECT DISTINCT h0.o, a.v AS node FROM h0 JOIN a ON a.u = h0.node),
h2 AS (SELECT DISTINCT h1.o, a.v AS node FROM h1 JOIN a ON a.u = h1.node),
h3 AS (SELECT DISTINCT h2.o, a.v AS node FROM h2 JOIN a ON a.u = h2.node),
r AS (SELECT * FROM h0 UNION SELECT * FROM h1 UNION SELECT * FROM h2 UNION SELECT * FROM h3)
SELECT COALESCE((SELECT SUM(ABS(amount)) FROM e WHERE EXISTS (SELECT 1 FROM r WHERE r.o = e.dst AND r.node = e.src))
       / (SELECT SUM(ABS(amount)) FROM e), 0.0) AS cyclic_flow_ratio""", "acct_edges"),
          doubles=["cyclic_flow_ratio"])
def q_cyclic_acct(spark, sf_dir):
    return gr.cyclic_flow_ratio(acct_edges(spark, sf_dir))


_DEG_SQL = """dgc AS (SELECT node, SUM(1.0) / ((SELECT COUNT(*) FROM (SELECT src AS node FROM acct_edges UNION SELECT dst FROM acct_edges) z) - 1) AS degree_centrality
  FROM (SELECT src AS node FROM acct_edges UNION ALL SELECT dst FROM acct_edges) e GROUP BY node)"""
_CLO_SQL = """clo AS (SELECT s AS node, CASE WHEN COUNT(*) > 1 AND COUNT(*) = (SELECT COUNT(*) FROM bnodes) AND SUM(dist) > 0
  THEN ((SELECT COUNT(*) FROM bnodes) - 1) * 1.0 / SUM(dist) ELSE 0.0 END AS closeness FROM blv GROUP BY s)"""


@register("importance_metrics", operators="R6 (all importance metrics in one frame, 0-filled)",
          sql=with_views("""SELECT d.node, d.degree_centrality, COALESCE(b.betweenness, 0.0) AS betweenness,
  COALESCE(c.closeness, 0.0) AS closeness, COALESCE(p.pagerank, 0.0) AS pagerank, COALESCE(k.clustering, 0.0) AS clustering,
  COALESCE(e.eigenvector, 0.0) AS eigenvector
FROM dgc d LEFT JOIN bbtw b ON b.node = d.node LEFT JOIN clo c ON c.node = d.node LEFT JOIN pagerank p ON p.node = d.node
LEFT JOIN clu k ON k.node = d.node LEFT JOIN eigen e ON e.node = d.node""", "acct_edges",
                         extra=_sql_bfs("acct_edges") + _sql_betweenness() + _sql_pagerank("acct_edges")
                         + _sql_eigen("acct_edges") + [_LOOP_ADJ_SQL, _DEG_SQL, _CLU_SQL, _CLO_SQL]),
          doubles=["degree_centrality", "betweenness", "closeness", "pagerank", "clustering", "eigenvector"])
def q_importance(spark, sf_dir):
    return gr.importance_metrics(acct_edges(spark, sf_dir))
