"""Registered queries: edge filters, weights, summaries, graph checks, top-k."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.assets import STABLECOIN_CODES
from ..operators import edges as ed
from ..operators import features as feat
from ..sources.adapters import acct_edges, trade_edges, with_views
from ..sources.tables import read_table
from .registry import register

_CODES = ", ".join(f"'{c}'" for c in STABLECOIN_CODES)
SQL_EDGE_TYPE = (f"CAST(CASE WHEN asset = 'XLM' THEN 0 WHEN upper(split_part(asset, ':', 1)) IN ({_CODES}) "
                 "THEN 1 ELSE 2 END AS BIGINT)")

_DEG_CTE = """deg AS (SELECT node, COUNT(*) AS deg FROM
   (SELECT src AS node FROM trade_edges UNION ALL SELECT dst FROM trade_edges) GROUP BY node)"""

T_START, T_END = 1704844800, 1705449599   # 2024-01-10 00:00:00 .. 2024-01-16 23:59:59 UTC


@register("window_slice", operators="F4 (inclusive both ends)",
          sql=with_views(f"SELECT src, dst, amount, ts, asset, edge_id FROM acct_edges "
                         f"WHERE ts BETWEEN {T_START} AND {T_END}", "acct_edges"),
          doubles=["amount"])
def q_window_slice(spark, sf_dir):
    return ed.window_slice(acct_edges(spark, sf_dir), T_START, T_END)


@register("window_nodes", operators="F4 nodes, S1 union of endpoints",
          sql=with_views(f"""SELECT src AS node FROM acct_edges WHERE ts BETWEEN {T_START} AND {T_END}
UNION SELECT dst FROM acct_edges WHERE ts BETWEEN {T_START} AND {T_END}""", "acct_edges"))
def q_window_nodes(spark, sf_dir):
    return ed.window_nodes(ed.window_slice(acct_edges(spark, sf_dir), T_START, T_END))


@register("last_n_days", operators="F5",
          sql=with_views("""SELECT e.src, e.dst, e.amount, e.ts, e.asset, e.edge_id
FROM acct_edges e CROSS JOIN (SELECT MAX(ts) AS now FROM acct_edges) r
WHERE e.ts >= GREATEST(0, r.now - 3 * 86400 + 1) AND e.ts <= r.now""", "acct_edges"),
          doubles=["amount"])
def q_last_n_days(spark, sf_dir):
    e = acct_edges(spark, sf_dir)
    now = e.agg(F.max("ts").alias("_now"))
    return ed.last_n_days(e.crossJoin(F.broadcast(now)), F.col("_now"), 3).drop("_now")


@register("filter_asset", operators="F3 F6",
          sql=with_views("SELECT src, dst, amount, ts, asset, edge_id FROM trade_edges "
                         "WHERE asset = '1-URGENT' AND dst = 's7'", "trade_edges"),
          doubles=["amount"])
def q_filter_asset(spark, sf_dir):
    return ed.filter_transactions(trade_edges(spark, sf_dir), to_account="s7", asset="1-URGENT")


@register("filter_normalized", operators="F2 (time range, account list, null amount -> 0)",
          sql=with_views(f"""SELECT src, dst, COALESCE(amount, 0.0) AS amount, ts, asset, edge_id
FROM acct_edges WHERE src IS NOT NULL AND src <> '' AND dst IS NOT NULL AND dst <> ''
  AND ts >= {T_START} AND ts <= {T_END} AND (src IN ('3', '7', '11') OR dst IN ('3', '7', '11'))""",
                         "acct_edges"),
          doubles=["amount"])
def q_filter_normalized(spark, sf_dir):
    return ed.filter_normalized(acct_edges(spark, sf_dir), T_START, T_END, ["3", "7", "11"])


@register("edge_type_counts", operators="F8",
          sql=with_views(f"SELECT {SQL_EDGE_TYPE} AS edge_type, CAST(COUNT(*) AS BIGINT) AS n "
                         "FROM acct_edges GROUP BY 1", "acct_edges"))
def q_edge_type_counts(spark, sf_dir):
    return ed.with_edge_type(acct_edges(spark, sf_dir)).groupBy("edge_type") \
        .agg(F.count(F.lit(1)).alias("n"))


@register("edge_weights", operators="G7 (sum by pair)",
          sql=with_views("SELECT src, dst, CAST(SUM(CAST(amount AS DECIMAL(38,7))) AS DOUBLE) AS weight FROM trade_edges WHERE src <> dst "
                         "GROUP BY src, dst", "trade_edges"),
          doubles=["weight"])
def q_edge_weights(spark, sf_dir):
    return ed.edge_weights(trade_edges(spark, sf_dir), "sum")


@register("edge_weights_asset_mean", operators="G7 (mean by pair and asset)",
          sql=with_views("SELECT src, dst, asset, CAST(SUM(CAST(amount AS DECIMAL(38,7))) AS DOUBLE) / COUNT(*) AS weight FROM acct_edges "
                         "WHERE src <> dst GROUP BY src, dst, asset", "acct_edges"),
          doubles=["weight"])
def q_edge_weights_asset(spark, sf_dir):
    return ed.edge_weights(acct_edges(spark, sf_dir), "mean", by_asset=True)


@register("weighted_graph", operators="G8 F8",
          sql=with_views(f"""SELECT src, dst, CAST(SUM(CAST(amount AS DECIMAL(38,7))) AS DOUBLE) AS weight, CAST(COUNT(*) AS BIGINT) AS transaction_count,
       first(edge_type ORDER BY ts, edge_id) AS edge_type
FROM (SELECT *, {SQL_EDGE_TYPE} AS edge_type FROM acct_edges) e WHERE src <> dst GROUP BY src, dst""",
                         "acct_edges"),
          doubles=["weight"])
def q_weighted_graph(spark, sf_dir):
    return ed.weighted_graph(acct_edges(spark, sf_dir))


@register("weighted_graph_transactions", operators="G8 (per-pair transaction list as a long table)",
          sql=with_views("""SELECT src, dst, edge_id, CAST(ROW_NUMBER() OVER (PARTITION BY src, dst ORDER BY ts, edge_id) - 1 AS BIGINT) AS position
FROM acct_edges WHERE src <> dst""", "acct_edges"))
def q_weighted_graph_tx(spark, sf_dir):
    return ed.weighted_graph_transactions(acct_edges(spark, sf_dir))


@register("graph_summary", operators="G9",
          sql=with_views("""SELECT
  (SELECT CAST(COUNT(*) AS BIGINT) FROM (SELECT src FROM trade_edges WHERE src <> dst UNION SELECT dst FROM trade_edges WHERE src <> dst)) AS node_count,
  CAST(COUNT(*) AS BIGINT) AS transaction_count,
  CAST(COUNT(DISTINCT (src, dst)) AS BIGINT) AS edge_count,
  CAST(COUNT(DISTINCT asset) AS BIGINT) AS asset_count
FROM trade_edges WHERE src <> dst""", "trade_edges"))
def q_graph_summary(spark, sf_dir):
    return ed.graph_summary(trade_edges(spark, sf_dir))


@register("asset_transaction_counts", operators="G9 (per asset)",
          sql=with_views("SELECT asset, CAST(COUNT(*) AS BIGINT) AS transaction_count FROM trade_edges "
                         "WHERE src <> dst GROUP BY asset", "trade_edges"))
def q_asset_counts(spark, sf_dir):
    return ed.asset_transaction_counts(trade_edges(spark, sf_dir))


@register("graph_statistics", operators="G10 (exact medians)",
          sql=with_views("""SELECT c.*, d.*, (c.num_edges * 1.0 / (d.num_nodes * (d.num_nodes - 1))) AS density, w.*
FROM (SELECT CAST(COUNT(*) AS BIGINT) AS num_edges, CAST(COUNT(DISTINCT src) AS BIGINT) AS num_source_nodes,
             CAST(COUNT(DISTINCT dst) AS BIGINT) AS num_target_nodes FROM trade_edges) c,
     (SELECT CAST(COUNT(*) AS BIGINT) AS num_nodes, AVG(deg) AS avg_degree, CAST(MIN(deg) AS BIGINT) AS degree_min,
             CAST(MAX(deg) AS BIGINT) AS degree_max, STDDEV_SAMP(deg) AS degree_std,
             QUANTILE_CONT(deg, 0.5) AS degree_median FROM deg) d,
     (SELECT MIN(amount) AS weight_min, MAX(amount) AS weight_max, AVG(amount) AS weight_mean,
             STDDEV_SAMP(amount) AS weight_std, CAST(SUM(CAST(amount AS DECIMAL(38,7))) AS DOUBLE) AS weight_sum,
             QUANTILE_CONT(amount, 0.5) AS weight_median FROM trade_edges) w""", "trade_edges",
                         extra=[_DEG_CTE]),
          doubles=["avg_degree", "degree_std", "degree_median", "density", "weight_min", "weight_max",
                   "weight_mean", "weight_std", "weight_sum", "weight_median"])
def q_graph_statistics(spark, sf_dir):
    return ed.graph_statistics(trade_edges(spark, sf_dir))


@register("edge_consistency", operators="Q9 S4",
          sql=with_views("""SELECT CAST(COUNT(*) AS BIGINT) AS num_edges,
  CAST(SUM(CASE WHEN src IS NULL OR dst IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_endpoints,
  CAST(SUM(CASE WHEN src = dst THEN 1 ELSE 0 END) AS BIGINT) AS self_loops,
  CAST(COUNT(DISTINCT (src, dst)) FILTER (WHERE src IS NOT NULL AND dst IS NOT NULL) AS BIGINT) AS distinct_pairs,
  CAST(SUM(CASE WHEN amount < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative_weights,
  CAST(COUNT(*) FILTER (WHERE src IS NOT NULL AND dst IS NOT NULL)
       - COUNT(DISTINCT (src, dst)) FILTER (WHERE src IS NOT NULL AND dst IS NOT NULL) AS BIGINT) AS duplicate_edges
FROM acct_edges_all""", "acct_edges_all"))
def q_edge_consistency(spark, sf_dir):
    return ed.edge_consistency(acct_edges(spark, sf_dir, keep_all=True))


_ALL_NODES_SQL = """all_nodes AS (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS node FROM customer
  UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR) FROM supplier
  UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR) FROM nation)"""


def _all_nodes(spark, sf_dir):
    """Customers, suppliers and nations; nations have no trades."""
    c = read_table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))
    s = read_table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"))
    n = read_table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"))
    return c.unionByName(s).unionByName(n)


@register("isolated_nodes", operators="J2 S3 (anti join)",
          sql=with_views("""SELECT DISTINCT node FROM all_nodes
WHERE node NOT IN (SELECT src FROM trade_edges UNION SELECT dst FROM trade_edges)""", "trade_edges",
                         extra=[_ALL_NODES_SQL]))
def q_isolated(spark, sf_dir):
    return ed.isolated_nodes(_all_nodes(spark, sf_dir), trade_edges(spark, sf_dir))


@register("validate_graph", operators="Q10 (checks + summary + passed)",
          sql=with_views("""SELECT CAST(COUNT(*) AS BIGINT) AS num_edges,
  CAST(SUM(CASE WHEN src IS NULL OR dst IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_endpoints,
  CAST(SUM(CASE WHEN src = dst THEN 1 ELSE 0 END) AS BIGINT) AS self_loops,
  CAST(COUNT(DISTINCT (src, dst)) AS BIGINT) AS distinct_pairs,
  CAST(SUM(CASE WHEN amount < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative_weights,
  CAST(COUNT(*) - COUNT(DISTINCT (src, dst)) AS BIGINT) AS duplicate_edges,
  (SELECT CAST(COUNT(*) AS BIGINT) FROM all_nodes WHERE node NOT IN (SELECT node FROM deg)) AS isolated_nodes,
  (SELECT CAST(COUNT(*) AS BIGINT) FROM deg) AS num_nodes,
  COUNT(*) * 1.0 / ((SELECT COUNT(*) FROM deg) * ((SELECT COUNT(*) FROM deg) - 1)) AS density,
  (SELECT AVG(deg) FROM deg) AS avg_degree,
  (COUNT(*) - COUNT(DISTINCT (src, dst))) = 0 AS passed
FROM trade_edges""", "trade_edges", extra=[_ALL_NODES_SQL, _DEG_CTE]),
          doubles=["density", "avg_degree"])
def q_validate_graph(spark, sf_dir):
    return ed.validate_graph(trade_edges(spark, sf_dir), _all_nodes(spark, sf_dir))


_METRICS = ["in_degree", "out_degree", "total_received", "total_sent"]


@register("top_accounts", operators="T1 (top-10 per metric)",
          sql=with_views("""SELECT node, metric, value, CAST(rank AS BIGINT) AS rank FROM (
  SELECT node, metric, value, row_number() OVER (PARTITION BY metric ORDER BY value DESC, node) AS rank
  FROM (UNPIVOT (SELECT node, CAST(SUM(1 - is_out) AS DOUBLE) AS in_degree, CAST(SUM(is_out) AS DOUBLE) AS out_degree,
                    CAST(SUM(CAST(CASE WHEN is_out = 0 THEN amount ELSE 0 END AS DECIMAL(38,7))) AS DOUBLE) AS total_received,
                    CAST(SUM(CAST(CASE WHEN is_out = 1 THEN amount ELSE 0 END AS DECIMAL(38,7))) AS DOUBLE) AS total_sent
             FROM (SELECT src AS node, 1 AS is_out, amount FROM trade_edges
                   UNION ALL SELECT dst, 0, amount FROM trade_edges) GROUP BY node)
        ON in_degree, out_degree, total_received, total_sent INTO NAME metric VALUE value)) t
WHERE rank <= 10""", "trade_edges"),
          doubles=["value"])
def q_top_accounts(spark, sf_dir):
    f = feat.node_features(trade_edges(spark, sf_dir))
    f = f.select("node", *[F.col(c).cast("double").alias(c) for c in _METRICS])
    return ed.top_k_per_metric(f, "node", _METRICS, 10)


@register("metric_summary", operators="G11",
          sql=with_views("""SELECT metric, AVG(value) AS mean, STDDEV_SAMP(value) AS std, MIN(value) AS min,
       MAX(value) AS max, CAST(SUM(CASE WHEN value <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS non_zero,
       QUANTILE_CONT(value, 0.5) AS median
FROM (UNPIVOT (SELECT node, CAST(SUM(1 - is_out) AS DOUBLE) AS in_degree, CAST(SUM(is_out) AS DOUBLE) AS out_degree,
                  CAST(SUM(CAST(CASE WHEN is_out = 0 THEN amount ELSE 0 END AS DECIMAL(38,7))) AS DOUBLE) AS total_received,
                  CAST(SUM(CAST(CASE WHEN is_out = 1 THEN amount ELSE 0 END AS DECIMAL(38,7))) AS DOUBLE) AS total_sent
           FROM (SELECT src AS node, 1 AS is_out, amount FROM acct_edges
                 UNION ALL SELECT dst, 0, amount FROM acct_edges) GROUP BY node)
      ON in_degree, out_degree, total_received, total_sent INTO NAME metric VALUE value)
GROUP BY metric""", "acct_edges"),
          doubles=["mean", "std", "min", "max", "median"])
def q_metric_summary(spark, sf_dir):
    f = feat.node_features(acct_edges(spark, sf_dir))
    f = f.select("node", *[F.col(c).cast("double").alias(c) for c in _METRICS])
    return ed.metric_summary(f, "node", _METRICS)
