"""Registered queries: time-ordered operators."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import temporal as tp
from ..sources.adapters import acct_edges, epoch_micros, scored, with_views
from ..sources.tables import read_table
from .registry import register

_EV_NORM_SQL = """evn AS (
  SELECT e.*, CASE WHEN m.mx > m.mn THEN (CAST(epoch_us(ts) AS DOUBLE) - m.mn) / (m.mx - m.mn)
                   ELSE CAST(epoch_us(ts) AS DOUBLE) END AS t_norm
  FROM events e CROSS JOIN (SELECT CAST(MIN(epoch_us(ts)) AS DOUBLE) AS mn,
                                   CAST(MAX(epoch_us(ts)) AS DOUBLE) AS mx FROM events) m)"""


def _events_norm(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value") \
        .withColumn("_us", epoch_micros("ts").cast("double"))
    return tp.minmax_normalize(ev, "_us", "t_norm").drop("_us")


@register("minmax_time", operators="W7 F6",
          sql=with_views("SELECT event_id, t_norm FROM evn WHERE t_norm >= 0.25 AND t_norm <= 0.5",
                         extra=[_EV_NORM_SQL]),
          doubles=["t_norm"])
def q_minmax(spark, sf_dir):
    return tp.filter_by_normalized_time(_events_norm(spark, sf_dir), 0.25, 0.5).select("event_id", "t_norm")


@register("rolling_features", operators="W1 (rows -5..+5 per account; chunk+halo windows)",
          sql=with_views("""SELECT user_id, event_id, t_norm,
  AVG(value) OVER w AS value_mean, STDDEV_SAMP(value) OVER w AS value_std,
  SUM(value * EXP(10.0 * t_norm)) OVER w / SUM(EXP(10.0 * t_norm)) OVER w AS value_wmean
FROM evn WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)""",
                         extra=[_EV_NORM_SQL]),
          doubles=["t_norm", "value_mean", "value_std", "value_wmean"])
def q_rolling(spark, sf_dir):
    ev = _events_norm(spark, sf_dir)
    out = tp.rolling_features(ev, ["user_id"], ["ts", "event_id"], "t_norm", ["value"], 10)
    return out.select("user_id", "event_id", "t_norm", "value_mean", "value_std", "value_wmean")


_DAYS_SQL = "(CAST(epoch_us(ts) - (SELECT MIN(epoch_us(ts)) FROM events) AS DOUBLE) / 86400000000.0)"


def _events_days(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    mn = ev.agg(F.min(epoch_micros("ts")).alias("_mn"))
    return (ev.crossJoin(F.broadcast(mn))
            .withColumn("t_days", (epoch_micros("ts") - F.col("_mn")).cast("double") / 86400000000.0)
            .drop("_mn"))


@register("trend", operators="W2 (OLS of sorted times on rank)",
          sql=f"""SELECT user_id,
  CASE WHEN COUNT(*) >= 2 THEN REGR_SLOPE(y, x) ELSE 0.0 END AS slope,
  CASE WHEN COUNT(*) >= 2 THEN AVG(y) - REGR_SLOPE(y, x) * AVG(x) ELSE 0.0 END AS intercept,
  CASE WHEN COUNT(*) >= 2 AND VAR_POP(y) > 0 THEN REGR_R2(y, x) ELSE 0.0 END AS r_squared
FROM (SELECT user_id, {_DAYS_SQL} AS y,
             CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS DOUBLE) AS x
      FROM events) t GROUP BY user_id""",
          doubles=["slope", "intercept", "r_squared"])
def q_trend(spark, sf_dir):
    return tp.trend(_events_days(spark, sf_dir), "user_id", "t_days", "event_id")


@register("gap_volatility", operators="W3 (lag per account)",
          sql=f"""SELECT user_id, COALESCE(AVG(gap), 0.0) AS mean_gap, COALESCE(STDDEV_SAMP(gap), 0.0) AS std_gap,
       COALESCE(MAX(gap), 0.0) AS max_gap
FROM (SELECT user_id, t - LAG(t) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap
      FROM (SELECT *, {_DAYS_SQL} AS t FROM events) e) g GROUP BY user_id""",
          doubles=["mean_gap", "std_gap", "max_gap"])
def q_gaps(spark, sf_dir):
    ev = _events_days(spark, sf_dir).withColumnRenamed("t_days", "t")
    return tp.gap_volatility(ev, "user_id", "t", "event_id")


@register("periodicity", operators="W4 (FFT power of daily counts; applyInPandas, bounded groups)",
          sql="""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, COUNT(*) AS c FROM events GROUP BY 1, 2),
b AS (SELECT user_id, MIN(day) AS d0, datediff('day', MIN(day), MAX(day)) + 1 AS n FROM d GROUP BY user_id),
s AS (SELECT b.user_id, b.n, g.i, COALESCE(d.c, 0) AS c
      FROM b, LATERAL (SELECT UNNEST(range(0, b.n)) AS i) g
      LEFT JOIN d ON d.user_id = b.user_id AND d.day = b.d0 + CAST(g.i AS INTEGER)),
p AS (SELECT s.user_id, s.n, k.k,
             POW(SUM(s.c * COS(2 * PI() * k.k * s.i / s.n)), 2) + POW(SUM(s.c * SIN(2 * PI() * k.k * s.i / s.n)), 2) AS pw
      FROM s, LATERAL (SELECT UNNEST(range(0, s.n)) AS k) k GROUP BY s.user_id, s.n, k.k),
r AS (SELECT user_id, n, pw, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY pw DESC) AS rk FROM p)
SELECT user_id,
  MAX(CASE WHEN n >= 10 AND rk = 1 AND rk <= n // 2 THEN pw ELSE 0.0 END) AS p1,
  MAX(CASE WHEN n >= 10 AND rk = 2 AND rk <= n // 2 THEN pw ELSE 0.0 END) AS p2,
  MAX(CASE WHEN n >= 10 AND rk = 3 AND rk <= n // 2 THEN pw ELSE 0.0 END) AS p3,
  MAX(CASE WHEN n >= 10 AND rk = 4 AND rk <= n // 2 THEN pw ELSE 0.0 END) AS p4,
  MAX(CASE WHEN n >= 10 AND rk = 5 AND rk <= n // 2 THEN pw ELSE 0.0 END) AS p5
FROM r GROUP BY user_id""",
          doubles=["p1", "p2", "p3", "p4", "p5"])
def q_periodicity(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"))
    daily = ev.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("c"))
    return tp.periodicity(daily, "user_id", "day", "c")


@register("temporal_consistency", operators="W5 (global lag via chunked windows)",
          sql=with_views("""SELECT 0.1 * AVG(d2) AS consistency_loss FROM (
  SELECT POW(y_prob - LAG(y_prob) OVER (ORDER BY ts, id), 2) AS d2 FROM scored) t WHERE d2 IS NOT NULL""",
                         "scored"),
          doubles=["consistency_loss"])
def q_consistency(spark, sf_dir):
    return tp.temporal_consistency(scored(spark, sf_dir), "y_prob", "ts", "id")


@register("smoothed_accuracy", operators="W6 (zero-padded average pool)",
          sql=with_views("""WITH r AS (SELECT CAST(y_pred = y_true AS DOUBLE) AS c,
         ROW_NUMBER() OVER (ORDER BY ts, id) - 1 AS j FROM scored),
kk AS (SELECT n, CASE WHEN k % 2 = 0 THEN k + 1 ELSE k END AS k FROM
       (SELECT COUNT(*) AS n, GREATEST(3, CAST(FLOOR(COUNT(*) * 0.05) AS BIGINT)) AS k FROM scored) z)
SELECT SUM(r.c * (LEAST(r.j + kk.k // 2, kk.n - 1) - GREATEST(r.j - kk.k // 2, 0) + 1)) / (kk.k * kk.n)
       AS smoothed_accuracy FROM r CROSS JOIN kk GROUP BY kk.k, kk.n""", "scored"),
          doubles=["smoothed_accuracy"])
def q_smoothed(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("correct", (F.col("y_pred") == F.col("y_true")).cast("int"))
    return tp.smoothed_accuracy(s, "correct", "ts", "id")


@register("time_windows", operators="W8 (overlapping normalised windows)",
          sql="WITH RECURSIVE " + _EV_NORM_SQL + """,
w(window_index, win_start) AS (
    SELECT 0, CAST(0.0 AS DOUBLE)
    UNION ALL SELECT window_index + 1, win_start + CAST(0.05 AS DOUBLE) FROM w
    WHERE win_start + CAST(0.05 AS DOUBLE) < 1.0)
SELECT CAST(w.window_index AS BIGINT) AS window_index, w.win_start, LEAST(w.win_start + 0.1, 1.0) AS win_end,
       CAST(COUNT(e.event_id) AS BIGINT) AS n
FROM w LEFT JOIN evn e ON e.t_norm >= w.win_start AND e.t_norm <= LEAST(w.win_start + 0.1, 1.0)
GROUP BY 1, 2, 3""",
          doubles=["win_start", "win_end"])
def q_time_windows(spark, sf_dir):
    wins = tp.time_windows(spark, 0.1, 0.5)
    ev = _events_norm(spark, sf_dir).select("event_id", "t_norm")
    # the window table has ceil(1/step) rows (parameter bound), so it is broadcast
    j = F.broadcast(wins).join(ev, (ev.t_norm >= wins.start) & (ev.t_norm <= wins.end), "left")
    return j.groupBy("window_index", F.col("start").alias("win_start"), F.col("end").alias("win_end")) \
        .agg(F.count("event_id").alias("n"))


@register("rolling_snapshots", operators="W9 (7d windows, 1d step, inclusive ends, empty windows kept)",
          sql=with_views("""WITH b AS (SELECT MIN(ts) AS t0, MAX(ts) AS tn FROM acct_edges),
w AS (SELECT CAST(i AS BIGINT) AS window_index, t0 + i * 86400 AS win_start, LEAST(t0 + i * 86400 + 604800, tn) AS win_end
      FROM b, LATERAL (SELECT UNNEST(range(0, CAST(CEIL((tn - t0) / 86400.0) AS BIGINT))) AS i) g),
m AS (SELECT w.window_index, e.src, e.dst FROM w JOIN acct_edges e ON e.ts >= w.win_start AND e.ts <= w.win_end)
SELECT w.window_index, w.win_start, w.win_end,
  CAST(COALESCE((SELECT COUNT(*) FROM m WHERE m.window_index = w.window_index), 0) AS BIGINT) AS edge_count,
  CAST(COALESCE((SELECT COUNT(DISTINCT node) FROM (SELECT src AS node FROM m WHERE m.window_index = w.window_index
        UNION ALL SELECT dst FROM m WHERE m.window_index = w.window_index)), 0) AS BIGINT) AS node_count
FROM w""", "acct_edges"))
def q_snapshots(spark, sf_dir):
    return tp.snapshot_summary(acct_edges(spark, sf_dir), "7d", "1d") \
        .withColumnRenamed("start", "win_start").withColumnRenamed("end", "win_end")
