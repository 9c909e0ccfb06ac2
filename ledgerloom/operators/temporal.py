"""Time-ordered operators: rolling features, trend, volatility, periodicity, consistency,
smoothed accuracy, normalisation, overlapping windows and rolling graph snapshots (W1-W9, F6).

Orders are total: callers pass a tie-break column.  No operator uses a window without a
partition key over row-level data; global orders go through ``plans.ordering``.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordering import windowed, with_global_rank

_UNITS = {"d": 86400, "h": 3600, "s": 1}


def parse_window_size(text: str) -> int:
    """'7d' / '24h' / '3600s' -> seconds."""
    unit = text[-1].lower()
    if unit not in _UNITS:
        raise ValueError(f"Unknown window unit {unit!r}. Use 'd', 'h', or 's'.")
    return int(text[:-1]) * _UNITS[unit]


def minmax_normalize(df: DataFrame, col: str, out: str = "t_norm") -> DataFrame:
    """(x - min) / (max - min) into [0, 1]; unchanged when max == min.  The two global
    scalars are one aggregate, broadcast as a single row."""
    mm = df.agg(F.min(col).alias("_mn"), F.max(col).alias("_mx"))
    x = F.col(col).cast("double")
    return (df.crossJoin(F.broadcast(mm))
            .withColumn(out, F.when(F.col("_mx") > F.col("_mn"),
                                    (x - F.col("_mn")) / (F.col("_mx") - F.col("_mn"))).otherwise(x))
            .drop("_mn", "_mx"))


def filter_by_normalized_time(df: DataFrame, start: float, end: float, col: str = "t_norm") -> DataFrame:
    """start <= t <= end, inclusive."""
    return df.where((F.col(col) >= start) & (F.col(col) <= end))


def rolling_features(df: DataFrame, partition_cols: list[str], order_cols: list[str],
                     time_col: str, feature_cols: list[str], window_size: int = 10,
                     chunk_rows: int = 1 << 22) -> DataFrame:
    """Rows i - w//2 .. i + w//2 in time order: mean, sample std and the time-weighted
    mean with weight exp(-(t_i - t_j)/0.1) of each feature, plus the row time.

    The weighted mean equals sum(f e^{10 t}) / sum(e^{10 t}) over the frame, so plain frame
    sums suffice (t in [0, 1] after W7 keeps e^{10 t} <= 2.2e4).
    """
    h = window_size // 2
    ex = F.exp(F.lit(10.0) * F.col(time_col))

    def build(w):
        f = w.rowsBetween(-h, h)
        cols = []
        for c in feature_cols:
            cols += [F.avg(c).over(f).alias(f"{c}_mean"),
                     F.stddev_samp(c).over(f).alias(f"{c}_std"),
                     (F.sum(F.col(c) * ex).over(f) / F.sum(ex).over(f)).alias(f"{c}_wmean")]
        return cols
    return windowed(df, partition_cols, order_cols, h, h, build, chunk_rows).drop("_g")


def trend(df: DataFrame, group_col: str, time_col: str, tie_col: str) -> DataFrame:
    """OLS of the sorted times on their position 0..n-1 per group: slope, intercept, r2.

    The position is the global rank minus the group's first rank; slope and r2 do not change
    under that shift, the intercept is corrected with it.  < 2 rows -> zeros; r2 = 0 when the
    times are constant.
    """
    r = with_global_rank(df.select(group_col, time_col, tie_col), [group_col, time_col, tie_col], "_g")
    y = F.col(time_col).cast("double")
    x = F.col("_g").cast("double")
    g = r.groupBy(group_col).agg(F.count(F.lit(1)).alias("_n"), F.regr_slope(y, x).alias("_s"),
                                 F.avg(y).alias("_my"), (F.avg(x) - F.min(x)).alias("_mx"),
                                 F.var_pop(y).alias("_vy"), F.regr_r2(y, x).alias("_r2"))
    ok = F.col("_n") >= 2
    return g.select(group_col,
                    F.when(ok, F.col("_s")).otherwise(0.0).alias("slope"),
                    F.when(ok, F.col("_my") - F.col("_s") * F.col("_mx")).otherwise(0.0).alias("intercept"),
                    F.when(ok & (F.col("_vy") > 0), F.col("_r2")).otherwise(0.0).alias("r_squared"))


def gap_volatility(df: DataFrame, group_col: str, time_col: str, tie_col: str,
                   chunk_rows: int = 1 << 22) -> DataFrame:
    """Mean, sample std and max of consecutive time gaps per group (< 2 rows -> zeros)."""
    lagged = windowed(df.select(group_col, time_col, tie_col), [group_col], [time_col, tie_col], 1, 0,
                      lambda w: [F.lag(time_col).over(w).alias("_prev")], chunk_rows)
    gaps = lagged.select(group_col, (F.col(time_col) - F.col("_prev")).cast("double").alias("gap"))
    agg = gaps.groupBy(group_col).agg(F.avg("gap").alias("mean_gap"),
                                      F.stddev_samp("gap").alias("std_gap"),
                                      F.max("gap").alias("max_gap"))
    return agg.select(group_col, *[F.coalesce(c, F.lit(0.0)).alias(c)
                                   for c in ("mean_gap", "std_gap", "max_gap")])


def periodicity(daily: DataFrame, group_col: str, day_col: str, count_col: str,
                top: int = 5, min_len: int = 10) -> DataFrame:
    """W4 (re-aimed): top-``top`` FFT power values of each group's zero-filled daily count
    series.  The series length is bounded by the number of days, not by the number of rows,
    so one hot account cannot blow up a Python worker.  Series shorter than ``min_len`` -> zeros.
    """
    out_schema = f"{group_col} {dict(daily.dtypes)[group_col]}, " + \
        ", ".join(f"p{i + 1} double" for i in range(top))

    def fft_top(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pdf[group_col].iloc[0]
        days = pd.to_datetime(pdf[day_col])
        full = pd.date_range(days.min(), days.max(), freq="D")
        s = pd.Series(pdf[count_col].to_numpy(dtype=float), index=days).reindex(full, fill_value=0.0)
        vals = np.zeros(top)
        if len(s) >= min_len:
            power = np.abs(np.fft.fft(s.to_numpy())) ** 2
            k = min(top, len(power) // 2)
            vals[:k] = np.sort(power)[::-1][:k]
        return pd.DataFrame([[key, *vals.tolist()]], columns=[group_col] + [f"p{i + 1}" for i in range(top)])
    return daily.groupBy(group_col).applyInPandas(fft_top, out_schema)


def temporal_consistency(df: DataFrame, pred_col: str, time_col: str, tie_col: str,
                         weight: float = 0.1) -> DataFrame:
    """Weight * mean((p_i - p_{i-1})^2) in global time order (one row)."""
    lagged = windowed(df.select(pred_col, time_col, tie_col), [], [time_col, tie_col], 1, 0,
                      lambda w: [F.lag(pred_col).over(w).alias("_prev")])
    d = lagged.where(F.col("_prev").isNotNull()).select(
        ((F.col(pred_col) - F.col("_prev")) ** 2).alias("d2"))
    return d.agg((F.lit(weight) * F.avg("d2")).alias("consistency_loss"))


def smoothed_accuracy(df: DataFrame, correct_col: str, time_col: str, tie_col: str,
                      tolerance: float = 0.05) -> DataFrame:
    """Mean over i of the zero-padded average pool (kernel k = max(3, floor(n tol)),
    made odd) of the correct flags in time order.  Row j contributes to
    min(j+p, n-1) - max(j-p, 0) + 1 pools of k, so one global rank and one sum suffice."""
    r = with_global_rank(df.select(correct_col, time_col, tie_col), [time_col, tie_col], "_j")
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    k = F.greatest(F.lit(3), F.floor(F.col("_n") * F.lit(tolerance)).cast("long"))
    k = F.when(k % 2 == 0, k + 1).otherwise(k)
    x = r.crossJoin(F.broadcast(n)).withColumn("_k", k).withColumn("_p", F.floor(F.col("_k") / 2))
    cnt = (F.least(F.col("_j") + F.col("_p"), F.col("_n") - 1)
           - F.greatest(F.col("_j") - F.col("_p"), F.lit(0)) + 1)
    return x.agg((F.sum(F.col(correct_col).cast("double") * cnt)
                  / (F.first("_k") * F.first("_n"))).alias("smoothed_accuracy"))


def time_windows(spark, window_size: float, overlap: float = 0.5) -> DataFrame:
    """Normalised windows (start, end) with step = size (1 - overlap) from 0 while start < 1.

    overlap >= 1 never advances and is rejected.  The table has ceil(1/step) rows, a bound
    set by the parameters, not by the data."""
    step = window_size * (1 - overlap)
    if step <= 0:
        raise ValueError("overlap must be < 1 and window_size > 0")
    rows, start, i = [], 0.0, 0
    while start < 1.0:
        rows.append((i, start, min(start + window_size, 1.0)))
        start += step
        i += 1
    return spark.createDataFrame(rows, "window_index long, start double, end double")


def rolling_snapshots(edges: DataFrame, size: str = "7d", step: str | None = None,
                      t0: Column | int | None = None, t_now: Column | int | None = None) -> DataFrame:
    """(window_index, start, end, src, dst, ts) for every edge in every window.

    Windows i = 0, 1, ... while t0 + i*step < t_now; end = least(t0 + i*step + size, t_now);
    both ends inclusive (a row on a boundary lands in two windows).  Null dst and self
    pairs are dropped.  Each edge is expanded only to the <= size/step + 1 windows that can
    hold it (``sequence``), never by a theta join against the window table.
    """
    size_s = parse_window_size(size)
    step_s = parse_window_size(step) if step else size_s
    e = edges.where(F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
    bounds = e.agg(F.min("ts").alias("_t0"), F.max("ts").alias("_tn"))
    if t0 is not None:
        bounds = bounds.withColumn("_t0", t0 if isinstance(t0, Column) else F.lit(t0))
    if t_now is not None:
        bounds = bounds.withColumn("_tn", t_now if isinstance(t_now, Column) else F.lit(t_now))
    x = e.crossJoin(F.broadcast(bounds))
    rel = F.col("ts") - F.col("_t0")
    lo = F.greatest(F.lit(0), F.ceil((rel - size_s) / F.lit(float(step_s))).cast("long"))
    hi = F.floor(rel / F.lit(float(step_s))).cast("long")
    x = (x.where((rel >= 0) & (hi >= lo))
         .withColumn("window_index", F.explode(F.sequence(lo, hi))))
    x = x.withColumn("start", F.col("_t0") + F.col("window_index") * step_s) \
         .withColumn("end", F.least(F.col("start") + size_s, F.col("_tn")))
    return (x.where((F.col("start") < F.col("_tn")) & (F.col("ts") >= F.col("start"))
                    & (F.col("ts") <= F.col("end")))
            .select("window_index", "start", "end", "src", "dst", "ts"))


def snapshot_summary(edges: DataFrame, size: str = "7d", step: str | None = None) -> DataFrame:
    """W9 per window, empty windows included: edge and node counts."""
    size_s = parse_window_size(size)
    step_s = parse_window_size(step) if step else size_s
    snap = rolling_snapshots(edges, size, step)
    e = edges.where(F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
    bounds = e.agg(F.min("ts").alias("_t0"), F.max("ts").alias("_tn"))
    nwin = bounds.select(F.ceil((F.col("_tn") - F.col("_t0")) / F.lit(float(step_s))).cast("long").alias("_nw"),
                         "_t0", "_tn")
    # window table: one row per window of the time span (bounded by span/step, not by rows)
    wins = nwin.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nw") - 1)).alias("window_index"),
                       "_t0", "_tn") \
        .select("window_index", (F.col("_t0") + F.col("window_index") * step_s).alias("start"),
                F.least(F.col("_t0") + F.col("window_index") * step_s + size_s, F.col("_tn")).alias("end"))
    ec = snap.groupBy("window_index").agg(F.count(F.lit(1)).alias("edge_count"))
    nodes = snap.select("window_index", F.explode(F.array("src", "dst")).alias("node"))
    nc = nodes.groupBy("window_index").agg(F.count_distinct("node").alias("node_count"))
    return (wins.join(ec, "window_index", "left").join(nc, "window_index", "left")
            .fillna({"edge_count": 0, "node_count": 0}))
