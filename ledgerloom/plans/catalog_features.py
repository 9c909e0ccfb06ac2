"""Registered queries: per-account features."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.assets import split_asset
from ..operators import features as feat
from ..sources.adapters import acct_edges, trade_edges, with_views
from ..sources.tables import read_table
from .registry import register

_EP_SQL = """ep AS (
  SELECT src AS node, 1 AS is_out, COALESCE(amount, 0.0) AS amount,
         COALESCE(CAST(ts AS DOUBLE), 0.0) AS ts, COALESCE(asset, 'UNKNOWN') AS asset FROM {v}
  WHERE src IS NOT NULL
  UNION ALL
  SELECT dst, 0, COALESCE(amount, 0.0), COALESCE(CAST(ts AS DOUBLE), 0.0),
         COALESCE(asset, 'UNKNOWN') FROM {v} WHERE dst IS NOT NULL)"""

_NODE_FEATURES_SQL = """
SELECT b.node, b.in_degree, b.out_degree, b.total_received, b.total_sent,
       GREATEST(r.ref - b.first_seen, 0.0) AS account_age, b.first_seen,
       d.unique_asset_count, d.asset_entropy
FROM (SELECT node, CAST(SUM(1 - is_out) AS BIGINT) AS in_degree, CAST(SUM(is_out) AS BIGINT) AS out_degree,
             CAST(SUM(CAST(CASE WHEN is_out = 0 THEN amount ELSE 0.0 END AS DECIMAL(38,7))) AS DOUBLE) AS total_received,
             CAST(SUM(CAST(CASE WHEN is_out = 1 THEN amount ELSE 0.0 END AS DECIMAL(38,7))) AS DOUBLE) AS total_sent,
             MIN(ts) AS first_seen
      FROM ep GROUP BY node) b
JOIN (SELECT node, CAST(COUNT(*) AS BIGINT) AS unique_asset_count,
             -SUM(p * LOG2(p)) AS asset_entropy
      FROM (SELECT node, asset, COUNT(*) * 1.0 / SUM(COUNT(*)) OVER (PARTITION BY node) AS p
            FROM ep GROUP BY node, asset) x GROUP BY node) d ON b.node = d.node
CROSS JOIN (SELECT COALESCE(MAX(COALESCE(CAST(ts AS DOUBLE), 0.0)), 0.0) AS ref FROM {v}) r
"""

_NF_DOUBLES = ["total_received", "total_sent", "account_age", "first_seen", "asset_entropy"]


@register("node_features", operators="G5 G6 J4 S1",
          sql=with_views(_NODE_FEATURES_SQL.format(v="acct_edges"), "acct_edges",
                         extra=[_EP_SQL.format(v="acct_edges")]),
          doubles=_NF_DOUBLES)
def q_node_features(spark, sf_dir):
    return feat.node_features(acct_edges(spark, sf_dir))


@register("node_features_trade", operators="G5 G6 (large bipartite graph)",
          sql=with_views(_NODE_FEATURES_SQL.format(v="trade_edges"), "trade_edges",
                         extra=[_EP_SQL.format(v="trade_edges")]),
          doubles=_NF_DOUBLES)
def q_node_features_trade(spark, sf_dir):
    return feat.node_features(trade_edges(spark, sf_dir))


@register("asset_diversity", operators="G6",
          sql=with_views("""
SELECT node, CAST(COUNT(*) AS BIGINT) AS unique_asset_count, -SUM(p * LOG2(p)) AS asset_entropy
FROM (SELECT node, asset, COUNT(*) * 1.0 / SUM(COUNT(*)) OVER (PARTITION BY node) AS p
      FROM ep GROUP BY node, asset) x GROUP BY node""", "trade_edges",
                         extra=[_EP_SQL.format(v="trade_edges")]),
          doubles=["asset_entropy"])
def q_asset_diversity(spark, sf_dir):
    return feat.asset_diversity(trade_edges(spark, sf_dir))


_DEG_SQL = """
SELECT node, CASE WHEN n.n <= 1 THEN 0.0 ELSE SUM(w) / (n.n - 1) END AS degree_centrality
FROM (SELECT src AS node, {w} AS w FROM {v} WHERE src IS NOT NULL
      UNION ALL SELECT dst, {w} FROM {v} WHERE dst IS NOT NULL) e
CROSS JOIN (SELECT COUNT(DISTINCT node) AS n FROM (SELECT src AS node FROM {v} UNION ALL SELECT dst FROM {v}) z) n
GROUP BY node, n.n"""


@register("degree_centrality", operators="G3 S1",
          sql=with_views(_DEG_SQL.format(w="1.0", v="acct_edges"), "acct_edges"),
          doubles=["degree_centrality"])
def q_degree(spark, sf_dir):
    return feat.degree_centrality(acct_edges(spark, sf_dir))


@register("degree_centrality_weighted", operators="G3 (weighted, falsy amount -> 1)",
          sql=with_views(_DEG_SQL.format(
              w="CASE WHEN amount IS NULL OR amount = 0 THEN 1.0 ELSE amount END",
              v="trade_edges"), "trade_edges"),
          doubles=["degree_centrality"])
def q_degree_weighted(spark, sf_dir):
    return feat.degree_centrality(trade_edges(spark, sf_dir), weighted=True)


@register("strength_in", operators="G4",
          sql=with_views("""
SELECT n.node, COALESCE(s.strength, 0.0) AS strength
FROM (SELECT src AS node FROM acct_edges UNION SELECT dst FROM acct_edges) n
LEFT JOIN (SELECT dst AS node, CAST(SUM(CAST(COALESCE(amount, 0.0) AS DECIMAL(38,7))) AS DOUBLE) AS strength FROM acct_edges GROUP BY dst) s
  ON n.node = s.node""", "acct_edges"),
          doubles=["strength"])
def q_strength_in(spark, sf_dir):
    return feat.strength(acct_edges(spark, sf_dir), "in")


@register("daily_frequency", operators="G1 X2",
          sql="""
WITH d AS (SELECT user_id AS account, CAST(ts AS DATE) AS day, COUNT(*) AS c FROM events GROUP BY 1, 2),
cal AS (SELECT account, UNNEST(generate_series(MIN(day), MAX(day), INTERVAL 1 DAY)) AS day
        FROM d GROUP BY account),
z AS (SELECT cal.account, COALESCE(d.c, 0) AS c FROM cal LEFT JOIN d
        ON cal.account = d.account AND CAST(cal.day AS DATE) = d.day),
m AS (SELECT account, AVG(c) AS mean_tx_per_day,
             CASE WHEN COUNT(*) > 1 THEN STDDEV_SAMP(c) ELSE 0.0 END AS std_tx_per_day FROM z GROUP BY account)
SELECT account, mean_tx_per_day, std_tx_per_day,
       CASE WHEN mean_tx_per_day + std_tx_per_day = 0 THEN 0.0
            ELSE (std_tx_per_day - mean_tx_per_day) / (std_tx_per_day + mean_tx_per_day) END AS burstiness
FROM m""",
          doubles=["mean_tx_per_day", "std_tx_per_day", "burstiness"])
def q_daily_frequency(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("account"),
                                                    F.col("ts").alias("timestamp"))
    return feat.daily_frequency(ev)


@register("decayed_amounts", operators="G12 X3",
          sql=with_views("""
SELECT src AS node, SUM(w * COALESCE(amount, 0.0)) AS decayed_sum,
       SUM(w * COALESCE(amount, 0.0)) / COUNT(*) AS decayed_mean,
       CASE WHEN SUM(w) = 0 THEN 0.0 ELSE SUM(w * COALESCE(amount, 0.0)) / SUM(w) END AS decayed_weighted_mean
FROM (SELECT e.*, CASE WHEN ts IS NULL THEN 1.0
                       ELSE EXP(-1e-6 * GREATEST(r.now - ts, 0)) END AS w
      FROM acct_edges e CROSS JOIN (SELECT MAX(ts) AS now FROM acct_edges) r) x
GROUP BY src""", "acct_edges"),
          doubles=["decayed_sum", "decayed_mean", "decayed_weighted_mean"])
def q_decayed(spark, sf_dir):
    e = acct_edges(spark, sf_dir)
    now = e.agg(F.max("ts").alias("now"))
    x = e.crossJoin(F.broadcast(now))
    return feat.decayed_aggregates(x, F.col("now"), 1e-6)


@register("temporal_basic", operators="G19 X1",
          sql=with_views("""
SELECT node, degree, sent, received, last_activity, received - sent AS balance,
       CASE WHEN sent + received = 0 THEN 0.0 ELSE (sent - received) / (sent + received) END AS net_flow_ratio
FROM (SELECT node, CAST(COUNT(*) AS BIGINT) AS degree,
             CAST(SUM(CAST(CASE WHEN is_out = 1 THEN a ELSE 0.0 END AS DECIMAL(38,7))) AS DOUBLE) AS sent,
             CAST(SUM(CAST(CASE WHEN is_out = 0 THEN a ELSE 0.0 END AS DECIMAL(38,7))) AS DOUBLE) AS received,
             GREATEST(MAX(ts), 0) AS last_activity
      FROM (SELECT src AS node, 1 AS is_out, COALESCE(amount, 0.0) AS a, ts FROM trade_edges
            UNION ALL SELECT dst, 0, COALESCE(amount, 0.0), ts FROM trade_edges) e
      GROUP BY node) g""", "trade_edges"),
          doubles=["sent", "received", "balance", "net_flow_ratio"])
def q_temporal_basic(spark, sf_dir):
    b = feat.temporal_basic_features(trade_edges(spark, sf_dir))
    return b.withColumn("net_flow_ratio", feat.net_flow_ratio(F.col("sent"), F.col("received")))


@register("log_net_flow_ratio", operators="X1 (imbalance of log-scaled volumes, base 10)",
          sql=with_views("""WITH f AS (SELECT node, CAST(SUM(CASE WHEN o = 1 THEN a ELSE 0 END) AS DOUBLE) AS sent,
    CAST(SUM(CASE WHEN o = 0 THEN a ELSE 0 END) AS DOUBLE) AS received FROM (
      SELECT src AS node, 1 AS o, CAST(COALESCE(amount, 0.0) AS DECIMAL(38,7)) AS a FROM acct_edges
      UNION ALL SELECT dst, 0, CAST(COALESCE(amount, 0.0) AS DECIMAL(38,7)) FROM acct_edges) e GROUP BY node),
g AS (SELECT node, LN(sent + 1.000000001) / LN(10) AS s, LN(received + 1.000000001) / LN(10) AS r FROM f)
SELECT node, CASE WHEN s + r = 0 THEN 0.0 ELSE (s - r) / (s + r) END AS ratio FROM g""", "acct_edges"), doubles=["ratio"])
def q_log_ratio(spark, sf_dir):
    b = feat.temporal_basic_features(acct_edges(spark, sf_dir))
    return b.select("node", feat.net_flow_ratio(F.col("sent"), F.col("received"), 10.0).alias("ratio"))


@register("asset_parts", operators="N10 (asset text into code and issuer)",
          sql=with_views("""SELECT asset, split_part(asset, ':', 1) AS code, CASE WHEN contains(asset, ':') THEN split_part(asset, ':', 2) END AS issuer,
  CAST(COUNT(*) AS BIGINT) AS n FROM acct_edges GROUP BY asset""", "acct_edges"))
def q_asset_parts(spark, sf_dir):
    a = acct_edges(spark, sf_dir).groupBy("asset").agg(F.count(F.lit(1)).alias("n"))
    code, issuer = split_asset(F.col("asset"))
    return a.select("asset", code.alias("code"), issuer.alias("issuer"), "n")
