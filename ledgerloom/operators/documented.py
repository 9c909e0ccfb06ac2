"""Operators the reference documents without code."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.assets import valid_account_id
from ..session import exact_sum
from .edges import last_n_days
from .features import daily_frequency, endpoints
from .graph import clustering_coefficient
from .temporal import gap_volatility

DAY = 86400


def min_activity_snapshot(edges: DataFrame, now, days: int, min_tx: int, weighted: bool = False) -> DataFrame:
    """Last-``days`` snapshot keeping only edges whose endpoints both have at least
    ``min_tx`` transactions in it; weight = amount or 1."""
    s = last_n_days(edges, now, days)
    active = endpoints(s).groupBy("node").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_tx).select("node")
    s = s.join(active.withColumnRenamed("node", "src"), "src", "left_semi") \
         .join(active.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return s.withColumn("weight", F.col("amount").cast("double") if weighted else F.lit(1.0))


def multiscale_degrees(edges: DataFrame, now, scales: tuple = (1, 7, 30, 90)) -> DataFrame:
    """Degree over the last 1/7/30/90 days in one grouped pass (conditional counts) and
    growth (d7 - d1)/max(d1, 1), (d30 - d7)/max(d7, 1)."""
    ep = endpoints(edges.withColumn("_nowc", now if isinstance(now, F.Column) else F.lit(now)), "ts", "_nowc")
    nowc = F.col("_nowc")
    aggs = [F.sum(((F.col("ts") > nowc - F.lit(s * DAY)) & (F.col("ts") <= nowc)).cast("long")).alias(f"degree_{s}d")
            for s in scales]
    g = ep.groupBy("node").agg(*aggs)
    return g.withColumn("growth_1_7", (F.col("degree_7d") - F.col("degree_1d")) / F.greatest(F.col("degree_1d"), F.lit(1))) \
            .withColumn("growth_7_30", (F.col("degree_30d") - F.col("degree_7d")) / F.greatest(F.col("degree_7d"), F.lit(1)))


def multiscale_clustering(edges: DataFrame, now, scales: tuple = (1, 7)) -> DataFrame:
    """Clustering coefficient over the last 1 and 7 days (R5 per window)."""
    out = None
    for s in scales:
        c = clustering_coefficient(last_n_days(edges, now, s)).withColumnRenamed("clustering", f"clustering_{s}d")
        out = c if out is None else out.join(c, "node", "full_outer")
    return out.fillna(0.0)


def composite_edge_weight(edges: DataFrame, now, w_amount: float = 0.7, w_freq: float = 0.3,
                          w_recency: float = 0.2, decay: float = 0.95) -> DataFrame:
    """N3 (decision): per (src, dst): .7 * amount/max amount + .3 * count/max count
    + .2 * mean(.95 ^ age_days)."""
    nowc = now if isinstance(now, F.Column) else F.lit(now)
    age = F.greatest(nowc - F.col("ts"), F.lit(0)) / F.lit(float(DAY))
    p = edges.groupBy("src", "dst").agg(exact_sum("amount").alias("amount"), F.count(F.lit(1)).alias("cnt"),
                                        F.avg(F.pow(F.lit(decay), age)).alias("recency"))
    mx = p.agg(F.max("amount").alias("_ma"), F.max("cnt").alias("_mc"))
    return p.crossJoin(F.broadcast(mx)).select(
        "src", "dst", (F.lit(w_amount) * F.col("amount") / F.col("_ma") + F.lit(w_freq) * F.col("cnt") / F.col("_mc")
                       + F.lit(w_recency) * F.col("recency")).alias("weight"))


def weighted_degree_summary(weights: DataFrame) -> DataFrame:
    """Average weighted degree (sum of weights over nodes, both ends), density."""
    ep = endpoints(weights, "weight")
    per = ep.groupBy("node").agg(F.sum("weight").alias("wd"))
    e = weights.agg(F.count(F.lit(1)).alias("_e"))
    return per.agg(F.avg("wd").alias("avg_weighted_degree"), F.count(F.lit(1)).alias("_n")).crossJoin(e).select(
        "avg_weighted_degree", F.when(F.col("_n") > 1, F.col("_e") / (F.col("_n") * (F.col("_n") - 1))).otherwise(0.0)
        .alias("density"))


def account_profile(edges: DataFrame) -> DataFrame:
    """Sent-amount statistics per account plus daily frequency (G1) and gap volatility
    (W3) of its sending times."""
    s = edges.select(F.col("src").alias("account"), "amount", "ts", "edge_id")
    stats = s.groupBy("account").agg(F.count(F.lit(1)).alias("n"), exact_sum("amount").alias("total"),
                                     F.min("amount").alias("min_amount"), F.max("amount").alias("max_amount"),
                                     F.stddev_samp("amount").alias("std_amount"))
    freq = daily_frequency(s.withColumn("timestamp", F.col("ts")), "account", "timestamp")
    gaps = gap_volatility(s.withColumn("t", F.col("ts").cast("double")), "account", "t", "edge_id")
    return stats.join(freq, "account").join(gaps, "account")


def normalization_filter(tx: DataFrame, min_amount: float = 0.0, account_cols: tuple = ("sender", "receiver"),
                         account_pattern: str | None = None) -> DataFrame:
    """Keep rows with valid account ids (public-key pattern by default), no test
    operations, amount >= minimum; timestamps are carried as UTC instants."""
    ok = ~F.lower(F.col("type")).startswith("test") & (F.coalesce(F.col("amount"), F.lit(0.0)) >= min_amount)
    for c in account_cols:
        valid = F.col(c).rlike(account_pattern) if account_pattern else valid_account_id(F.col(c))
        ok = ok & (F.col(c).isNull() | valid)
    return tx.where(ok)


def class_weights(labels: DataFrame, label_col: str) -> DataFrame:
    """weight_c = n / (classes * count_c)."""
    c = labels.groupBy(label_col).agg(F.count(F.lit(1)).alias("count"))
    t = labels.agg(F.count(F.lit(1)).alias("_n"), F.count_distinct(label_col).alias("_k"))
    return c.crossJoin(F.broadcast(t)).select(label_col, "count", (F.col("_n") / (F.col("_k") * F.col("count"))).alias("weight"))


def ensemble(probs: DataFrame, id_col: str = "id", class_col: str = "class", prob_col: str = "prob",
             truth: DataFrame | None = None) -> DataFrame:
    """Mean class probability over models, argmax (ties to the smallest class) and, with a
    truth table (id, label), the ensemble accuracy as a column."""
    m = probs.groupBy(id_col, class_col).agg(F.avg(prob_col).alias("p"))
    pred = m.groupBy(id_col).agg(F.min_by(class_col, F.struct((-F.col("p")).alias("np"), F.col(class_col))).alias("pred"),
                                 F.max("p").alias("confidence"))
    if truth is None:
        return pred
    j = pred.join(truth, id_col)
    acc = j.agg(F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy"))
    return j.crossJoin(F.broadcast(acc))


def quality_alerts(scored: DataFrame, window_seconds: int, max_error_rate: float = 0.05, min_accuracy: float = 0.8) -> DataFrame:
    """Per time window: error rate (invalid records) and accuracy; alert flags."""
    w = F.floor(F.col("ts") / window_seconds) * window_seconds
    g = scored.groupBy(w.alias("window_start")).agg(
        F.avg((~F.col("is_valid")).cast("double")).alias("error_rate"),
        F.avg((F.col("y_pred") == F.col("y_true")).cast("double")).alias("accuracy"))
    return g.withColumn("error_alert", F.col("error_rate") > max_error_rate) \
            .withColumn("accuracy_alert", F.col("accuracy") < min_accuracy)
