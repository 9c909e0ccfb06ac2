"""Registered queries: sampling, propagation, link-prediction tasks, account scoring."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import sql_draw60
from ..operators import features as feat
from ..operators import propagate as pg
from ..operators import sampling as sm
from ..sources.adapters import acct_edges, next_in_sequence, with_views
from ..session import cut_lineage
from ..sources.tables import read_table
from .registry import register

_FCOLS = ["in_degree", "out_degree", "total_received", "total_sent"]


def _feats(spark, sf_dir):
    f = feat.node_features(acct_edges(spark, sf_dir))
    return f.select("node", *[F.col(c).cast("double").alias(c) for c in _FCOLS])


_FEATS_SQL = """nf AS (SELECT node, CAST(SUM(1 - is_out) AS DOUBLE) AS in_degree, CAST(SUM(is_out) AS DOUBLE) AS out_degree,
    CAST(SUM(CAST(CASE WHEN is_out = 0 THEN amount ELSE 0.0 END AS DECIMAL(38,7))) AS DOUBLE) AS total_received,
    CAST(SUM(CAST(CASE WHEN is_out = 1 THEN amount ELSE 0.0 END AS DECIMAL(38,7))) AS DOUBLE) AS total_sent
  FROM (SELECT src AS node, 1 AS is_out, amount FROM acct_edges UNION ALL SELECT dst, 0, amount FROM acct_edges) e GROUP BY node)"""


def _adj(spark, sf_dir):
    return sm.in_neighbours(acct_edges(spark, sf_dir))


@register("neighbor_sample_counts", operators="R8 (exactly k samples per node with in-neighbours)",
          sql=with_views("SELECT dst AS node, CAST(5 AS BIGINT) AS n_samples, COUNT(*) >= 5 AS without_replacement "
                         "FROM acct_edges GROUP BY dst", "acct_edges"))
def q_nbr_counts(spark, sf_dir):
    s = sm.sample_neighbors(_adj(spark, sf_dir), 5)
    return s.groupBy("node").agg(F.count(F.lit(1)).alias("n_samples"),
                                 (F.count_distinct("edge") == 5).alias("without_replacement"))


def _sql_sample(name: str, frontier: str | None, k: int, seed: int) -> list[str]:
    """CTEs of a sample of k in-neighbours of the frontier's nodes."""
    only = f" WHERE dst IN (SELECT node FROM {frontier})" if frontier else ""
    return [f"""{name}_o AS MATERIALIZED (SELECT dst AS node, src AS neighbor, edge_id AS edge, COUNT(*) OVER (PARTITION BY dst) AS deg,
  ROW_NUMBER() OVER (PARTITION BY dst ORDER BY {sql_draw60(str(seed), 'dst', 'src', 'edge_id')}, src, edge_id) - 1 AS pos FROM acct_edges{only})""",
            f"""{name} AS MATERIALIZED (SELECT node, pos AS slot, neighbor, edge FROM {name}_o WHERE deg >= {k} AND pos < {k}
  UNION ALL SELECT o.node, d.slot, o.neighbor, o.edge FROM (SELECT DISTINCT node, deg, UNNEST(range({k})) AS slot FROM {name}_o WHERE deg < {k}) d
  JOIN {name}_o o ON o.node = d.node AND o.pos = {sql_draw60(str(seed), 'd.node', 'd.slot')} % d.deg)"""]


@register("neighbor_sample", operators="R8 (in-neighbours with parallel edges, hash-seeded)",
          sql=with_views("SELECT node, CAST(slot AS BIGINT) AS slot, neighbor, edge FROM s", "acct_edges",
                         extra=_sql_sample("s", None, 5, 42)))
def q_nbr_sample(spark, sf_dir):
    return sm.sample_neighbors(_adj(spark, sf_dir), 5)


_HOPS2_SQL = (["h0 AS (SELECT DISTINCT dst AS node FROM acct_edges WHERE dst IN ('1', '2', '3'))"]
              + _sql_sample("s1", "h0", 25, 43)
              + ["h1 AS MATERIALIZED (SELECT DISTINCT neighbor AS node FROM s1 WHERE neighbor NOT IN (SELECT node FROM h0))"]
              + _sql_sample("s2", "h1", 10, 44)
              + ["h2 AS (SELECT DISTINCT neighbor AS node FROM s2 WHERE neighbor NOT IN (SELECT node FROM h0 UNION SELECT node FROM h1))"])


def _two_hops(spark, sf_dir):
    adj = _adj(spark, sf_dir)
    targets = adj.select(F.col("u").alias("node")).distinct().where(F.col("node").isin("1", "2", "3"))
    return sm.multi_hop_sample(adj, targets, [25, 10])


@register("multi_hop_sample", operators="R9 J10 (fanout [25, 10] frontier joins: nodes, targets first, local indices)",
          sql=with_views("""SELECT node, CAST(ROW_NUMBER() OVER (ORDER BY hop, node) - 1 AS BIGINT) AS local_index, CAST(hop AS BIGINT) AS hop
FROM (SELECT node, 0 AS hop FROM h0 UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2) n""",
                         "acct_edges", extra=_HOPS2_SQL))
def q_multi_hop(spark, sf_dir):
    return _two_hops(spark, sf_dir)[1]


@register("multi_hop_edges", operators="R9 J10 (the sampled edges of both hops)",
          sql=with_views("""SELECT CAST(1 AS BIGINT) AS hop, node, CAST(slot AS BIGINT) AS slot, neighbor, edge FROM s1
UNION ALL SELECT 2, node, slot, neighbor, edge FROM s2""", "acct_edges", extra=_HOPS2_SQL))
def q_multi_hop_edges(spark, sf_dir):
    return _two_hops(spark, sf_dir)[0]


_NM_SQL = """SELECT n.node, """ + ", ".join(
    f"CASE WHEN COUNT(e.src) > 0 THEN CAST(SUM(CAST(s.{c} AS DECIMAL(38,7))) AS DOUBLE) / COUNT(e.src) ELSE 0.0 END AS {c}"
    for c in _FCOLS) + """
FROM nf n LEFT JOIN (SELECT src, dst FROM acct_edges) e ON e.dst = n.node LEFT JOIN nf s ON s.node = e.src GROUP BY n.node"""


@register("neighbor_mean", operators="R10 (mean of in-neighbour features)",
          sql=with_views(_NM_SQL, "acct_edges", extra=[_FEATS_SQL]), doubles=_FCOLS)
def q_nbr_mean(spark, sf_dir):
    return pg.neighbor_mean(acct_edges(spark, sf_dir), _feats(spark, sf_dir), _FCOLS, exact_sums=True)


@register("gcn_propagate", operators="R12 (symmetric normalised propagation with self loops)",
          sql=with_views("""WITH d AS (SELECT n.node, COUNT(e.dst) + 1 AS d FROM nf n LEFT JOIN acct_edges e ON e.dst = n.node GROUP BY n.node),
a AS (SELECT src, dst FROM acct_edges UNION ALL SELECT node, node FROM nf)
SELECT a.dst AS node, """ + ", ".join(f"SUM(s.{c} / SQRT(ds.d * dd.d)) AS {c}" for c in _FCOLS) + """
FROM a JOIN d ds ON ds.node = a.src JOIN d dd ON dd.node = a.dst JOIN nf s ON s.node = a.src GROUP BY a.dst""",
                         "acct_edges", extra=[_FEATS_SQL]), doubles=_FCOLS)
def q_gcn(spark, sf_dir):
    return pg.gcn_propagate(acct_edges(spark, sf_dir), _feats(spark, sf_dir), _FCOLS)


@register("attention_aggregate", operators="R11 (per-node softmax over incoming edges, 2 heads)",
          sql=with_views("""WITH x AS (SELECT e.src, e.dst, h.head, LN(e.amount + 1) * (h.head + 1) AS s
    FROM acct_edges e CROSS JOIN (SELECT UNNEST([0, 1]) AS head) h),
y AS (SELECT *, EXP(s - MAX(s) OVER (PARTITION BY dst, head)) AS ex FROM x),
z AS (SELECT *, ex / GREATEST(SUM(ex) OVER (PARTITION BY dst, head), 1e-9) AS alpha FROM y)
SELECT z.dst AS node, CAST(z.head AS BIGINT) AS head, SUM(alpha) AS alpha_sum, """ + ", ".join(
              f"SUM(alpha * f.{c}) AS {c}" for c in _FCOLS) + """
FROM z JOIN nf f ON f.node = z.src GROUP BY z.dst, z.head""", "acct_edges", extra=[_FEATS_SQL]),
          doubles=["alpha_sum"] + _FCOLS)
def q_attention(spark, sf_dir):
    a = pg.attention_aggregate(acct_edges(spark, sf_dir), _feats(spark, sf_dir), _FCOLS,
                               F.log(F.col("amount") + 1), heads=2)
    return a.withColumn("head", F.col("head").cast("long"))


@register("pair_scores", operators="R13 (dot product and sigmoid of embedding pairs)",
          sql="""SELECT u, v, score, 1.0 / (1.0 + EXP(-score)) AS probability FROM (
  SELECT p.u, p.v, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score
  FROM (SELECT vec_id AS u, LEAD(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS v FROM embeddings) p
  JOIN embeddings a ON a.vec_id = p.u JOIN embeddings b ON b.vec_id = p.v WHERE p.v IS NOT NULL) s""",
          doubles=["score", "probability"])
def q_pairs(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings")
    nx = next_in_sequence(emb.select("vec_id", "label").withColumn("_b", F.floor(F.col("vec_id") / 1000)),
                          ["label"], ["vec_id"], "vec_id", "v", "_b")
    pairs = nx.where(F.col("v").isNotNull()).select(F.col("vec_id").alias("u"), "v")
    return pg.pair_scores(pairs, emb, "vec_id", "embedding")


@register("graph_index", operators="R14 J6 (contiguous ids, edge index, bounds check)",
          sql=with_views("""SELECT CAST((SELECT COUNT(*) FROM (SELECT src FROM acct_edges UNION SELECT dst FROM acct_edges) n) AS BIGINT) AS num_nodes,
  CAST(COUNT(*) AS BIGINT) AS num_edges, CAST(0 AS BIGINT) AS out_of_bounds FROM acct_edges""", "acct_edges"))
def q_graph_index(spark, sf_dir):
    _, _, chk = pg.graph_index(acct_edges(spark, sf_dir))
    return chk


@register("edge_index", operators="R14 (edge endpoints as contiguous indices)",
          sql=with_views("""WITH idx AS (SELECT node, DENSE_RANK() OVER (ORDER BY node) - 1 AS idx FROM
    (SELECT src AS node FROM acct_edges UNION SELECT dst FROM acct_edges) n)
SELECT CAST(a.idx AS BIGINT) AS src_idx, CAST(b.idx AS BIGINT) AS dst_idx, e.amount, e.ts
FROM acct_edges e JOIN idx a ON a.node = e.src JOIN idx b ON b.node = e.dst""", "acct_edges"),
          doubles=["amount"])
def q_edge_index(spark, sf_dir):
    _, ei, _ = pg.graph_index(acct_edges(spark, sf_dir))
    return ei


def _ledger_edges(spark, sf_dir):
    return acct_edges(spark, sf_dir).withColumn("ledger", F.floor(F.col("ts") / 3600))


@register("link_prediction_splits", operators="K1 J7 W11 (boundary splits: last 10 context ledgers, 5 future ledgers)",
          sql=with_views("""WITH e AS (SELECT src, dst, ts // 3600 AS t FROM acct_edges),
l AS (SELECT t, DENSE_RANK() OVER (ORDER BY t) AS r FROM (SELECT DISTINCT t FROM e) d),
er AS (SELECT e.*, l.r FROM e JOIN l ON e.t = l.t),
ctx AS (SELECT b.t AS b, er.src, er.dst FROM l b JOIN er ON er.r < b.r AND er.r >= b.r - 10),
fut AS (SELECT b.t AS b, e.src, e.dst FROM l b JOIN e ON e.t >= b.t AND e.t < b.t + 5),
nc AS (SELECT b, COUNT(*) AS n_context FROM ctx GROUP BY b),
nfu AS (SELECT b, COUNT(*) AS n_future FROM fut GROUP BY b),
nn AS (SELECT b, COUNT(DISTINCT a) AS n_nodes FROM (SELECT b, src AS a FROM ctx UNION ALL SELECT b, dst FROM ctx
       UNION ALL SELECT b, src FROM fut UNION ALL SELECT b, dst FROM fut) x GROUP BY b)
SELECT CAST(nc.b AS BIGINT) AS boundary, CAST(n_context AS BIGINT) AS n_context, CAST(n_future AS BIGINT) AS n_future,
       CAST(n_nodes AS BIGINT) AS n_nodes
FROM nc JOIN nfu ON nc.b = nfu.b JOIN nn ON nn.b = nc.b""", "acct_edges"))
def q_lp_splits(spark, sf_dir):
    return sm.link_prediction_splits(_ledger_edges(spark, sf_dir), "ledger", 5, 10)


_SPLIT_SQL = ["""e AS MATERIALIZED (SELECT src, dst, ts // 3600 AS t FROM acct_edges)""",
              """l AS MATERIALIZED (SELECT t, DENSE_RANK() OVER (ORDER BY t) AS r FROM (SELECT DISTINCT t FROM e) d)""",
              """sp AS MATERIALIZED (SELECT b.t AS split, 'context' AS part, e.src, e.dst FROM l b JOIN l x ON x.r < b.r AND x.r >= b.r - 10 JOIN e ON e.t = x.t
  UNION ALL SELECT b.t, 'future', e.src, e.dst FROM l b JOIN e ON e.t >= b.t AND e.t < b.t + 5 WHERE b.r > 1)"""]


@register("link_prediction_edges", operators="K1 (context and future edges of every split)",
          sql=with_views("SELECT CAST(split AS BIGINT) AS split, part, src, dst FROM sp", "acct_edges", extra=_SPLIT_SQL))
def q_lp_edges(spark, sf_dir):
    return sm.split_edges(_ledger_edges(spark, sf_dir), "ledger", 5, 10)


@register("negative_samples", operators="K2 J8 (hash draws among the accounts of context and future, no positive or self pairs)",
          sql=with_views(f"""WITH nd AS MATERIALIZED (SELECT split, node, ROW_NUMBER() OVER (PARTITION BY split ORDER BY node) - 1 AS i,
    COUNT(*) OVER (PARTITION BY split) AS n FROM (SELECT split, src AS node FROM sp UNION SELECT split, dst FROM sp) x),
q AS (SELECT split, COUNT(*) AS n_neg FROM sp WHERE part = 'future' GROUP BY split),
d AS (SELECT q.split, q.n_neg, m.n, UNNEST(range(q.n_neg * 10)) AS draw FROM q JOIN (SELECT DISTINCT split, n FROM nd) m ON m.split = q.split),
p AS MATERIALIZED (SELECT split, n_neg, draw, {sql_draw60('42', 'split', 'draw', '0')} % n AS u, {sql_draw60('42', 'split', 'draw', '1')} % n AS v FROM d),
c AS (SELECT p.split, p.n_neg, a.node AS u, b.node AS v, MIN(p.draw) AS draw FROM p JOIN nd a ON a.split = p.split AND a.i = p.u
      JOIN nd b ON b.split = p.split AND b.i = p.v WHERE p.u <> p.v
      AND NOT EXISTS (SELECT 1 FROM sp f WHERE f.part = 'future' AND f.split = p.split AND f.src = a.node AND f.dst = b.node)
      GROUP BY 1, 2, 3, 4)
SELECT CAST(split AS BIGINT) AS split, u, v FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY split ORDER BY draw) AS k FROM c) r WHERE k <= n_neg""",
                         "acct_edges", extra=_SPLIT_SQL))
def q_negatives(spark, sf_dir):
    s = cut_lineage(sm.split_edges(_ledger_edges(spark, sf_dir), "ledger", 5, 10))
    nodes = s.select("split", F.explode(F.array("src", "dst")).alias("node")).distinct()
    future = s.where("part = 'future'").select("split", "src", "dst")
    return sm.negative_samples(nodes, future, future.groupBy("split").agg(F.count(F.lit(1)).alias("n_neg")))


_STD_SQL = """zs AS (SELECT node, """ + ", ".join(
    f"CASE WHEN s_{c} > 0 THEN ({c} - m_{c}) / s_{c} ELSE 0.0 END AS {c}" for c in _FCOLS) + """
  FROM nf CROSS JOIN (SELECT """ + ", ".join(f"AVG({c}) AS m_{c}, STDDEV_POP({c}) AS s_{c}" for c in _FCOLS) + """ FROM nf) st)"""


def _nm_sql(src: str, out: str) -> str:
    return f"""{out} AS (SELECT n.node, """ + ", ".join(
        f"CASE WHEN COUNT(e.src) > 0 THEN SUM(s.{c}) / COUNT(e.src) ELSE 0.0 END AS {c}" for c in _FCOLS) + f"""
  FROM {src} n LEFT JOIN (SELECT src, dst FROM acct_edges) e ON e.dst = n.node LEFT JOIN {src} s ON s.node = e.src GROUP BY n.node)"""


_K5_SQL = [_FEATS_SQL, _STD_SQL, _nm_sql("zs", "h1"), _nm_sql("h1", "h2"),
           """vec AS (SELECT z.node, [""" + ", ".join(f"z.{c}" for c in _FCOLS) + ", " + ", ".join(f"h.{c}" for c in _FCOLS) + """] AS v
  FROM zs z JOIN h2 h ON h.node = z.node)""",
           """ex AS (SELECT node, d, x FROM (SELECT node, UNNEST(range(0, len(v))) AS d, UNNEST(v) AS x FROM vec) u)""",
           """st2 AS (SELECT d, AVG(x) AS mu, STDDEV_POP(x) AS sd FROM ex GROUP BY d)""",
           """sc AS (SELECT ex.node, SUM(POW(CASE WHEN st2.sd > 0 THEN (ex.x - st2.mu) / st2.sd ELSE 0.0 END, 2)) AS score
  FROM ex JOIN st2 ON ex.d = st2.d GROUP BY ex.node)"""]


@register("score_accounts", operators="K5 R10 K3 (2-hop mean embedding + raw features -> sphere score; absent -> inf)",
          sql=with_views("""SELECT a.node, COALESCE(sc.score, CAST('inf' AS DOUBLE)) AS score FROM
  (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS node FROM customer) a LEFT JOIN sc ON sc.node = a.node""",
                         "acct_edges", extra=_K5_SQL), doubles=["score"])
def q_score_accounts(spark, sf_dir):
    accounts = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("node"))
    return pg.score_accounts(acct_edges(spark, sf_dir), _feats(spark, sf_dir), _FCOLS, accounts)
