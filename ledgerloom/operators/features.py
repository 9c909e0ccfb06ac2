"""Per-account features over an edge table ``(src, dst, amount, ts, asset)``.

All aggregates are two-level (partial aggregate before the shuffle) so one hub account
holding a large share of the edges does not land in one task un-combined.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

LOG2 = math.log(2.0)
MONEY = "decimal(38,7)"   # amounts carry at most 7 decimals: exact, order-independent sums


def endpoints(edges: DataFrame, *extra: str, keep_null: bool = False) -> DataFrame:
    """One row per (edge, endpoint): node, is_out (1 for src, 0 for dst) and ``extra`` columns.

    A self-loop yields two rows (one out, one in), as the reference counts it on both sides.
    """
    side = F.explode(F.array(
        F.struct(F.col("src").alias("node"), F.lit(1).alias("is_out")),
        F.struct(F.col("dst").alias("node"), F.lit(0).alias("is_out"))))
    sel = edges.select(side.alias("_e"), *extra)
    out = sel.select("_e.node", "_e.is_out", *[c for c in sel.columns if c != "_e"])
    return out if keep_null else out.where(F.col("node").isNotNull())


def _entropy_from_counts(total: Column, sum_clogc: Column) -> Column:
    """Shannon entropy (bits) of counts c_i with sum T: log2 T - sum(c log2 c)/T."""
    return F.when(total > 0, (F.log2(total) - sum_clogc / total)).otherwise(F.lit(0.0))


def asset_diversity(edges: DataFrame, asset_col: str = "asset") -> DataFrame:
    """Distinct assets with a positive count and Shannon entropy (base 2) per node.

    A missing asset counts as ``UNKNOWN``.
    """
    ep = endpoints(edges, F.coalesce(F.col(asset_col), F.lit("UNKNOWN")).alias("asset"))
    per = ep.groupBy("node", "asset").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("node").agg(
        F.count(F.lit(1)).alias("unique_asset_count"),
        _entropy_from_counts(F.sum("c"), F.sum(F.col("c") * F.log2("c"))).alias("asset_entropy"))


def node_features(edges: DataFrame, first_seen: DataFrame | None = None,
                  ref_time: float | None = None) -> DataFrame:
    """G5 + G6: in/out degree, total received/sent, first_seen, account_age, asset diversity.

    * null amount -> 0.0, null timestamp -> 0.0 (as the reference's falsy rule);
    * ref_time defaults to the max edge timestamp (one scalar aggregate, broadcast as 1 row);
    * ``first_seen(node, first_seen)`` overrides the observed first time; nodes only in it
      are added with zero degrees and volumes (J5).

    Two aggregation levels: (node, asset) with partial aggregation, then node.
    """
    ep = endpoints(edges,
                   F.coalesce(F.col("amount").cast("double"), F.lit(0.0)).alias("amount"),
                   F.coalesce(F.col("ts").cast("double"), F.lit(0.0)).alias("ts"),
                   F.coalesce(F.col("asset"), F.lit("UNKNOWN")).alias("asset"))
    per_asset = ep.groupBy("node", "asset").agg(
        F.count(F.lit(1)).alias("c"),
        F.sum("is_out").alias("n_out"),
        F.sum(F.when(F.col("is_out") == 1, F.col("amount")).otherwise(0.0).cast(MONEY)).alias("sent"),
        F.sum(F.when(F.col("is_out") == 0, F.col("amount")).otherwise(0.0).cast(MONEY)).alias("recv"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    feats = per_asset.groupBy("node").agg(
        (F.sum("c") - F.sum("n_out")).alias("in_degree"),
        F.sum("n_out").alias("out_degree"),
        F.sum("recv").cast("double").alias("total_received"),
        F.sum("sent").cast("double").alias("total_sent"),
        F.min("first_ts").alias("first_seen_edge"), F.max("last_ts").alias("_last"),
        F.count(F.lit(1)).alias("unique_asset_count"),
        _entropy_from_counts(F.sum("c"), F.sum(F.col("c") * F.log2("c"))).alias("asset_entropy"))

    if ref_time is None:
        # max edge time = max over the per-node maxima.  The node table is written once
        # (reliable checkpoint; one row per node, far smaller than the edges) so the edges are
        # scanned once - a pruned second branch would not reuse the first one's exchanges.
        feats = cut_lineage(feats)
        ref = feats.agg(F.coalesce(F.max("_last"), F.lit(0.0)).alias("_ref"))
    else:
        ref = edges.sparkSession.range(1).select(F.lit(float(ref_time)).alias("_ref"))

    if first_seen is not None:
        fs = first_seen.select(F.col("node"), F.col("first_seen").cast("double").alias("_fs"))
        feats = (feats.join(fs, "node", "full_outer")
                 .select("node",
                         F.coalesce("in_degree", F.lit(0)).alias("in_degree"),
                         F.coalesce("out_degree", F.lit(0)).alias("out_degree"),
                         F.coalesce("total_received", F.lit(0.0)).alias("total_received"),
                         F.coalesce("total_sent", F.lit(0.0)).alias("total_sent"),
                         F.coalesce("_fs", "first_seen_edge").alias("first_seen"),
                         F.coalesce("unique_asset_count", F.lit(0)).alias("unique_asset_count"),
                         F.coalesce("asset_entropy", F.lit(0.0)).alias("asset_entropy"), "_last"))
    else:
        feats = feats.withColumnRenamed("first_seen_edge", "first_seen")

    return (feats.crossJoin(F.broadcast(ref))
            .withColumn("account_age", F.greatest(F.col("_ref") - F.col("first_seen"), F.lit(0.0)))
            .select("node", F.col("in_degree").cast("long"), F.col("out_degree").cast("long"),
                    "total_received", "total_sent", "account_age", "first_seen",
                    F.col("unique_asset_count").cast("long"), "asset_entropy"))


def node_count(edges: DataFrame, extra_nodes: DataFrame | None = None) -> DataFrame:
    """One-row frame ``n`` = number of distinct non-null endpoints (plus ``extra_nodes.node``)."""
    nodes = endpoints(edges).select("node")
    if extra_nodes is not None:
        nodes = nodes.unionByName(extra_nodes.select("node"))
    return nodes.agg(F.count_distinct("node").alias("_n"))


def degree_centrality(edges: DataFrame, weighted: bool = False,
                      extra_nodes: DataFrame | None = None) -> DataFrame:
    """(weighted) endpoint count / (n - 1); n <= 1 -> 0.

    Weighted: amount, with 0 and null weighing 1.0 (the reference's falsy rule).
    Self-loops count twice, parallel edges each count, a null endpoint still credits the other.
    """
    w = (F.when(F.col("amount").isNull() | (F.col("amount") == 0), F.lit(1.0))
         .otherwise(F.col("amount").cast("double"))) if weighted else F.lit(1.0)
    ep = endpoints(edges, w.alias("w"))
    deg = ep.groupBy("node").agg(F.sum("w").alias("d"))
    if extra_nodes is not None:
        deg = deg.join(extra_nodes.select("node").distinct(), "node", "full_outer") \
                 .fillna({"d": 0.0})
    n = node_count(edges, extra_nodes)
    return (deg.crossJoin(F.broadcast(n))
            .select("node", F.when(F.col("_n") <= 1, F.lit(0.0))
                    .otherwise(F.col("d") / (F.col("_n") - 1)).alias("degree_centrality")))


def strength(edges: DataFrame, direction: str = "both") -> DataFrame:
    """Summed amount per node (null -> 0): 'in', 'out' or 'both'."""
    if direction not in ("in", "out", "both"):
        raise ValueError("direction must be in, out or both")
    ep = endpoints(edges, F.coalesce(F.col("amount").cast("double"), F.lit(0.0)).alias("a"))
    if direction == "out":
        ep = ep.where("is_out = 1")
    elif direction == "in":
        ep = ep.where("is_out = 0")
    # nodes present on the other side still appear with 0 (reference adds every endpoint)
    all_nodes = endpoints(edges).select("node").distinct()
    s = ep.groupBy("node").agg(F.sum(F.col("a").cast(MONEY)).cast("double").alias("strength"))
    return all_nodes.join(s, "node", "left").fillna({"strength": 0.0})


def daily_frequency(tx: DataFrame, account_col: str = "account",
                    ts_col: str = "timestamp") -> DataFrame:
    """G1: mean and sample std of zero-filled daily counts, and burstiness, per account.

    Closed form: with s = sum of daily counts, q = sum of squares, n = days from the first to
    the last active day inclusive: mean = s/n, var = (n q - s^2)/(n (n - 1)) (0 for n = 1).
    Burstiness (sd - mean)/(sd + mean), 0 when both are 0.  A null account or timestamp raises
    when the query runs.
    """
    given = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"Column '{c}' contains null values"))
                             .cast(tx.schema[c].dataType)).otherwise(F.col(c))
    tx = tx.select(given(account_col).alias(account_col), given(ts_col).alias(ts_col))
    t = F.col(ts_col)
    if isinstance(tx.schema[ts_col].dataType, (T.NumericType,)):
        # numeric epochs: one max-abs aggregate picks the unit for the whole column
        # (< 1e11 seconds, < 1e14 milliseconds, < 1e17 microseconds, else nanoseconds); UTC days
        unit = tx.agg(F.max(F.abs(t)).alias("_m")).select(
            F.when(F.col("_m") < 1e11, 1.0).when(F.col("_m") < 1e14, 1e3).when(F.col("_m") < 1e17, 1e6)
            .otherwise(1e9).alias("_unit"))
        tx = tx.crossJoin(F.broadcast(unit))
        day = F.date_from_unix_date(F.floor(t / F.col("_unit") / 86400).cast("int"))
    else:
        day = F.to_date(t)
    d = tx.select(F.col(account_col).alias("_acct"), day.alias("_day"))
    daily = d.groupBy("_acct", "_day").agg(F.count(F.lit(1)).alias("c"))
    per = daily.groupBy("_acct").agg(
        F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"),
        (F.datediff(F.max("_day"), F.min("_day")) + 1).alias("n"))
    n = F.col("n").cast("double")
    s = F.col("s").cast("double")
    var = F.when(F.col("n") > 1, (n * F.col("q") - s * s) / (n * (n - 1))).otherwise(0.0)
    out = per.select(F.col("_acct").alias(account_col), (s / n).alias("mean_tx_per_day"),
                     F.sqrt(F.greatest(var, F.lit(0.0))).alias("std_tx_per_day"))
    m, sd = F.col("mean_tx_per_day"), F.col("std_tx_per_day")
    return out.withColumn("burstiness",
                          F.when((m + sd) == 0, F.lit(0.0)).otherwise((sd - m) / (sd + m)))


def account_frequency(tx: DataFrame, account, account_col: str = "account",
                      ts_col: str = "timestamp") -> DataFrame:
    """G1 for one account (pushed-down filter); an unknown account raises when the query runs."""
    one = daily_frequency(tx.where(F.col(account_col) == F.lit(account)), account_col, ts_col)
    names = one.columns
    kind = tx.schema[account_col].dataType
    found = one.agg(F.first(F.struct(*names)).alias("r"))      # one row, null if there is none
    known = F.when(F.col("r").isNull(), F.raise_error(F.lit(f"Account {account!r} not found")).cast(kind)) \
        .otherwise(F.col(f"r.{account_col}"))
    return found.select(known.alias(account_col), *[F.col(f"r.{c}") for c in names[1:]])


def decayed_aggregates(edges: DataFrame, now: Column | float, lam: float,
                       group_col: str = "src") -> DataFrame:
    """G12 per group: decayed sum, mean and weighted mean with w = exp(-lam * max(0, now - ts)).

    Missing timestamp -> weight 1; missing amount -> 0.  mean = decayed sum / count;
    weighted_mean = sum(w a) / sum(w), 0 when sum(w) = 0.
    """
    nowc = now if isinstance(now, Column) else F.lit(float(now))
    w = F.when(F.col("ts").isNull(), F.lit(1.0)).otherwise(
        F.exp(-F.lit(lam) * F.greatest(nowc - F.col("ts"), F.lit(0.0))))
    a = F.coalesce(F.col("amount").cast("double"), F.lit(0.0))
    g = edges.select(F.col(group_col).alias("node"), w.alias("w"), (w * a).alias("wa"))
    return g.groupBy("node").agg(
        F.sum("wa").alias("decayed_sum"),
        (F.sum("wa") / F.count(F.lit(1))).alias("decayed_mean"),
        F.when(F.sum("w") == 0, F.lit(0.0)).otherwise(F.sum("wa") / F.sum("w"))
         .alias("decayed_weighted_mean"))


def temporal_basic_features(edges: DataFrame) -> DataFrame:
    """Degree (in + out), sent, received, balance = received - sent, last activity."""
    ep = endpoints(edges, F.coalesce(F.col("amount").cast("double"), F.lit(0.0)).alias("a"),
                   F.col("ts"))
    return ep.groupBy("node").agg(
        F.count(F.lit(1)).alias("degree"),
        F.sum(F.when(F.col("is_out") == 1, F.col("a")).otherwise(0.0).cast(MONEY)).cast("double").alias("sent"),
        F.sum(F.when(F.col("is_out") == 0, F.col("a")).otherwise(0.0).cast(MONEY)).cast("double").alias("received"),
        F.greatest(F.max("ts"), F.lit(0)).alias("last_activity")) \
        .withColumn("balance", F.col("received") - F.col("sent"))


def net_flow_ratio(sent: Column, received: Column, log_base: float | None = None) -> Column:
    """(sent - received) / (sent + received), 0 when the sum is 0; with ``log_base`` of the
    log-scaled amounts."""
    if log_base is not None:
        if log_base <= 0 or abs(log_base - 1) < 1e-8:
            raise ValueError("log_base must be positive and not 1")
        sent, received = log_scale(sent, log_base), log_scale(received, log_base)
    tot = sent + received
    return F.when(tot == 0, F.lit(0.0)).otherwise((sent - received) / tot)


def log_scale(x: Column, base: float = math.e, eps: float = 1e-9) -> Column:
    """log_base(x + 1 + eps)."""
    return F.log(x + F.lit(1.0 + eps)) / F.lit(math.log(base))


def imbalance_features(edges: DataFrame) -> DataFrame:
    """X1 per node: sent, received, net flow ratio and log-scaled volumes."""
    b = temporal_basic_features(edges)
    return b.select("node", "sent", "received",
                    net_flow_ratio(F.col("sent"), F.col("received")).alias("net_flow_ratio"),
                    log_scale(F.col("sent")).alias("log_sent"),
                    log_scale(F.col("received")).alias("log_received"))


def decay_weight(delta: Column, lam: float) -> Column:
    """exp(-lam * delta), delta < 0 -> 1."""
    return F.when(delta < 0, F.lit(1.0)).otherwise(F.exp(-F.lit(lam) * delta))
