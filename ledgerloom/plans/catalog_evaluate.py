"""Registered queries: calibration, metrics, AUC/AP, thresholds, ranking, one-class scoring."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import temperature_scale
from ..operators import evaluate as ev
from ..operators.temporal import minmax_normalize
from ..sources.adapters import scored, with_views
from ..sources.tables import read_table
from .registry import register

_SC = ["scored"]
_CLIP = "LEAST(GREATEST(y_prob, 1e-15), 1 - 1e-15)"
_BIN = "CAST(LEAST(FLOOR(y_prob * 10), 9) AS INTEGER)"


@register("calibration_curve", operators="E1 (uniform bins, non-empty only)",
          sql=with_views(f"""SELECT CAST({_BIN} AS BIGINT) AS bin, AVG(CAST(y_true AS DOUBLE)) AS fraction_positive,
  AVG(y_prob) AS mean_predicted, CAST(COUNT(*) AS BIGINT) AS n FROM scored GROUP BY 1""", *_SC),
          doubles=["fraction_positive", "mean_predicted"])
def q_cal_curve(spark, sf_dir):
    return ev.calibration_curve(scored(spark, sf_dir))


@register("calibration_curve_quantile", operators="E1 (quantile bins)",
          sql=with_views("""WITH q AS (SELECT """ + ", ".join(f"QUANTILE_CONT(y_prob, {i / 10}) AS q{i}" for i in range(1, 10)) + """ FROM scored),
b AS (SELECT s.*, """ + " + ".join(f"CAST(y_prob > q{i} AS INTEGER)" for i in range(1, 10)) + """ AS bin FROM scored s CROSS JOIN q)
SELECT CAST(bin AS BIGINT) AS bin, AVG(CAST(y_true AS DOUBLE)) AS fraction_positive, AVG(y_prob) AS mean_predicted,
  CAST(COUNT(*) AS BIGINT) AS n FROM b GROUP BY bin""", *_SC), doubles=["fraction_positive", "mean_predicted"])
def q_cal_curve_q(spark, sf_dir):
    return ev.calibration_curve(scored(spark, sf_dir), strategy="quantile")


_CAL_ERR_SQL = f"""SELECT AVG(POW(y_prob - y_true, 2)) AS brier,
  -AVG(y_true * LN({_CLIP}) + (1 - y_true) * LN(1 - {_CLIP})) AS log_loss,
  (SELECT SUM(n * ABS(fp - mp)) / SUM(n) FROM (SELECT COUNT(*) AS n, AVG(CAST(y_true AS DOUBLE)) AS fp, AVG(y_prob) AS mp
      FROM {{t}} GROUP BY {_BIN}) b) AS ece,
  (SELECT MAX(ABS(fp - mp)) FROM (SELECT AVG(CAST(y_true AS DOUBLE)) AS fp, AVG(y_prob) AS mp FROM {{t}} GROUP BY {_BIN}) b) AS mce,
  GREATEST(AVG(GREATEST(y_prob, 1 - y_prob)) - AVG(CAST(CAST(y_prob > 0.5 AS INTEGER) = y_true AS DOUBLE)), 0.0) AS overconfidence,
  GREATEST(AVG(CAST(CAST(y_prob > 0.5 AS INTEGER) = y_true AS DOUBLE)) - AVG(GREATEST(y_prob, 1 - y_prob)), 0.0) AS underconfidence,
  VAR_POP(y_prob) AS sharpness FROM {{t}}"""

_CAL_DOUBLES = ["brier", "log_loss", "ece", "mce", "overconfidence", "underconfidence", "sharpness"]


@register("calibration_errors", operators="E2 E4 (Brier, log loss, ECE, MCE, over/under-confidence, sharpness)",
          sql=with_views(_CAL_ERR_SQL.format(t="scored"), *_SC), doubles=_CAL_DOUBLES)
def q_cal_errors(spark, sf_dir):
    return ev.calibration_errors(scored(spark, sf_dir))


@register("calibration_report", operators="E5 (errors, ratings and advice by fixed thresholds)",
          sql=with_views(f"""SELECT ece, mce, brier, log_loss, overconfidence, underconfidence, sharpness,
  CASE WHEN brier < 0.1 THEN 'excellent' WHEN brier < 0.2 THEN 'good' WHEN brier < 0.35 THEN 'fair' ELSE 'poor' END AS brier_rating,
  CASE WHEN ece < 0.01 THEN 'excellent' WHEN ece < 0.05 THEN 'good' WHEN ece < 0.1 THEN 'fair' ELSE 'poor' END AS ece_rating,
  CONCAT_WS(',', CASE WHEN brier > 0.25 THEN 'improve_discrimination' END, CASE WHEN ece > 0.05 THEN 'apply_calibration' END,
    CASE WHEN overconfidence > 0.1 THEN 'overconfident' END, CASE WHEN underconfidence > 0.1 THEN 'underconfident' END,
    CASE WHEN sharpness < 0.05 THEN 'low_sharpness' END) AS advice
FROM ({_CAL_ERR_SQL.format(t='scored')}) e""", *_SC), doubles=_CAL_DOUBLES)
def q_cal_report(spark, sf_dir):
    return ev.calibration_report(scored(spark, sf_dir))


@register("adaptive_calibration_error", operators="E3 (quantile bins, max row excluded)",
          sql=with_views("""WITH q AS (SELECT """ + ", ".join(f"QUANTILE_CONT(y_prob, {i / 10}) AS q{i}" for i in range(11)) + """ FROM scored),
b AS (SELECT s.*, CASE """ + " ".join(f"WHEN y_prob >= q{i} AND y_prob < q{i + 1} THEN {i}" for i in range(10)) + """ END AS bn
      FROM scored s CROSS JOIN q)
SELECT SUM(c * 1.0 / (SELECT COUNT(*) FROM scored) * ABS(a - m)) AS ace FROM (
  SELECT bn, COUNT(*) AS c, AVG(CAST(y_true AS DOUBLE)) AS a, AVG(y_prob) AS m FROM b WHERE bn IS NOT NULL GROUP BY bn) x""",
                         *_SC), doubles=["ace"])
def q_ace(spark, sf_dir):
    return ev.adaptive_calibration_error(scored(spark, sf_dir))


_SWEEP_SQL = """sweep AS (SELECT threshold, precision, recall, calibration_error,
  CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM (
  SELECT t.threshold,
    CASE WHEN SUM(CASE WHEN y_prob >= t.threshold THEN 1 ELSE 0 END) > 0
         THEN SUM(CASE WHEN y_prob >= t.threshold AND y_true = 1 THEN 1 ELSE 0 END) * 1.0 / SUM(CASE WHEN y_prob >= t.threshold THEN 1 ELSE 0 END) ELSE 0.0 END AS precision,
    CASE WHEN SUM(y_true) > 0 THEN SUM(CASE WHEN y_prob >= t.threshold AND y_true = 1 THEN 1 ELSE 0 END) * 1.0 / SUM(y_true) ELSE 0.0 END AS recall,
    COALESCE(ABS(AVG(CASE WHEN y_prob >= t.threshold THEN y_prob END) - AVG(CASE WHEN y_prob >= t.threshold THEN CAST(y_true AS DOUBLE) END)), 0.0) AS calibration_error
  FROM scored CROSS JOIN (SELECT CAST(0.1 AS DOUBLE) + i * CAST(0.05 AS DOUBLE) AS threshold FROM range(16) r(i)) t
  GROUP BY t.threshold) z)"""


@register("threshold_sweep", operators="E7 (16 thresholds: precision, recall, F1, calibration error)",
          sql=with_views("SELECT * FROM sweep", *_SC, extra=[_SWEEP_SQL]),
          doubles=["threshold", "precision", "recall", "calibration_error", "f1"])
def q_sweep(spark, sf_dir):
    return ev.threshold_sweep(scored(spark, sf_dir))


@register("best_threshold", operators="E7 D14 (best F1 with calibration error < 0.1)",
          sql=with_views("""SELECT arg_max(threshold, (f1, threshold)) AS threshold, MAX(f1) AS f1 FROM sweep
WHERE calibration_error < 0.1""", *_SC, extra=[_SWEEP_SQL]), doubles=["threshold", "f1"])
def q_best_threshold(spark, sf_dir):
    return ev.best_threshold(ev.threshold_sweep(scored(spark, sf_dir)))


@register("anomaly_metrics", operators="E10 E9 N14 (confusion-based binary metrics)",
          sql=with_views("""SELECT (tp + tn) * 1.0 / (tp + fp + fn + tn) AS accuracy,
  CASE WHEN tp + fp > 0 THEN tp * 1.0 / (tp + fp) ELSE 0.0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp * 1.0 / (tp + fn) ELSE 0.0 END AS recall,
  CASE WHEN fp + tn > 0 THEN fp * 1.0 / (fp + tn) ELSE 0.0 END AS false_positive_rate,
  CASE WHEN fn + tp > 0 THEN fn * 1.0 / (fn + tp) ELSE 0.0 END AS false_negative_rate,
  CASE WHEN tp + fn > 0 THEN tp * 1.0 / (tp + fn) ELSE 0.0 END AS detection_rate,
  CASE WHEN tp + fp > 0 AND tp + fn > 0 AND tp > 0
       THEN 2.0 * (tp * 1.0 / (tp + fp)) * (tp * 1.0 / (tp + fn)) / ((tp * 1.0 / (tp + fp)) + (tp * 1.0 / (tp + fn))) ELSE 0.0 END AS f1
FROM (SELECT SUM(CASE WHEN y_pred = 1 AND y_true = 1 THEN 1 ELSE 0 END) AS tp, SUM(CASE WHEN y_pred = 1 AND y_true = 0 THEN 1 ELSE 0 END) AS fp,
             SUM(CASE WHEN y_pred = 0 AND y_true = 1 THEN 1 ELSE 0 END) AS fn, SUM(CASE WHEN y_pred = 0 AND y_true = 0 THEN 1 ELSE 0 END) AS tn
      FROM scored) c""", *_SC),
          doubles=["accuracy", "precision", "recall", "false_positive_rate", "false_negative_rate", "detection_rate", "f1"])
def q_anomaly(spark, sf_dir):
    return ev.binary_metrics(scored(spark, sf_dir))


@register("confusion_matrix", operators="N14",
          sql=with_views("""SELECT CAST(SUM(CASE WHEN y_pred = 1 AND y_true = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
  CAST(SUM(CASE WHEN y_pred = 1 AND y_true = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(SUM(CASE WHEN y_pred = 0 AND y_true = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
  CAST(SUM(CASE WHEN y_pred = 0 AND y_true = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn FROM scored""", *_SC))
def q_confusion(spark, sf_dir):
    return ev.confusion(scored(spark, sf_dir))


_EMB_CLS_SQL = """cls AS (SELECT vec_id, label AS y, CAST(((vec_id * 7) % 10 + label) % 10 AS INTEGER) AS p FROM embeddings)"""


@register("classification_metrics", operators="E8 (weighted and per-class P/R/F1, accuracy)",
          sql=with_views("""SELECT CAST(label AS VARCHAR) AS class, precision, recall, support,
  CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1,
  CAST(NULL AS DOUBLE) AS accuracy FROM (
  SELECT l.y AS label, CASE WHEN SUM(CASE WHEN c.p = l.y THEN 1 ELSE 0 END) > 0
           THEN SUM(CASE WHEN c.p = l.y AND c.y = l.y THEN 1 ELSE 0 END) * 1.0 / SUM(CASE WHEN c.p = l.y THEN 1 ELSE 0 END) ELSE 0.0 END AS precision,
         SUM(CASE WHEN c.p = l.y AND c.y = l.y THEN 1 ELSE 0 END) * 1.0 / SUM(CASE WHEN c.y = l.y THEN 1 ELSE 0 END) AS recall,
         CAST(SUM(CASE WHEN c.y = l.y THEN 1 ELSE 0 END) AS BIGINT) AS support
  FROM cls c CROSS JOIN (SELECT DISTINCT y FROM cls) l GROUP BY l.y) per
UNION ALL
SELECT 'weighted', SUM(precision * support) / SUM(support), SUM(recall * support) / SUM(support), CAST(SUM(support) AS BIGINT),
       SUM(f1 * support) / SUM(support), (SELECT AVG(CAST(y = p AS DOUBLE)) FROM cls) FROM (
  SELECT precision, recall, support, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM (
    SELECT l.y AS label, CASE WHEN SUM(CASE WHEN c.p = l.y THEN 1 ELSE 0 END) > 0
             THEN SUM(CASE WHEN c.p = l.y AND c.y = l.y THEN 1 ELSE 0 END) * 1.0 / SUM(CASE WHEN c.p = l.y THEN 1 ELSE 0 END) ELSE 0.0 END AS precision,
           SUM(CASE WHEN c.p = l.y AND c.y = l.y THEN 1 ELSE 0 END) * 1.0 / SUM(CASE WHEN c.y = l.y THEN 1 ELSE 0 END) AS recall,
           SUM(CASE WHEN c.y = l.y THEN 1 ELSE 0 END) AS support
    FROM cls c CROSS JOIN (SELECT DISTINCT y FROM cls) l GROUP BY l.y) a) b""", extra=[_EMB_CLS_SQL]),
          doubles=["precision", "recall", "f1", "accuracy"])
def q_classification(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    c = e.select("vec_id", F.col("label").alias("y"),
                 F.pmod(F.pmod(F.col("vec_id") * 7, F.lit(10)) + F.col("label"), F.lit(10)).cast("int").alias("p"))
    return ev.classification_metrics(c, "y", "p")


@register("regression_metrics", operators="E11 (MSE, RMSE, MAE, R2, MAPE)",
          sql="""SELECT mse, SQRT(mse) AS rmse, mae, CASE WHEN vy > 0 THEN 1 - ssr / (vy * n) ELSE 0.0 END AS r2, CASE WHEN nonzero = 1 THEN mape * 100 ELSE CAST('infinity' AS DOUBLE) END AS mape
FROM (SELECT AVG(POW(y - p, 2)) AS mse, AVG(ABS(y - p)) AS mae, SUM(POW(y - p, 2)) AS ssr, VAR_POP(y) AS vy, COUNT(*) AS n,
             MAX(CAST(y <> 0 AS INTEGER)) AS nonzero,
             AVG(CASE WHEN y <> 0 THEN ABS((y - p) / y) WHEN p = 0 THEN CAST('nan' AS DOUBLE) ELSE CAST('infinity' AS DOUBLE) END) AS mape
      FROM (SELECT l_extendedprice AS y, l_quantity * p_retailprice AS p FROM lineitem JOIN part ON l_partkey = p_partkey) j) a""",
          doubles=["mse", "rmse", "mae", "r2", "mape"])
def q_regression(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice")
    pt = read_table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    j = li.join(pt, li.l_partkey == pt.p_partkey).select(F.col("l_extendedprice").alias("y"),
                                                       (F.col("l_quantity") * F.col("p_retailprice")).alias("p"))
    return ev.regression_metrics(j, "y", "p")


_AUC_SQL = """SELECT CASE WHEN P > 0 AND N > 0 THEN (rs - P * (P + 1) / 2.0) / (P * N) ELSE {fb} END AS auc FROM (
  SELECT SUM(pos * avg_rank) AS rs, (SELECT SUM(y_true) FROM {t}) AS P, (SELECT SUM(1 - y_true) FROM {t}) AS N FROM (
    SELECT y_prob, SUM(y_true) AS pos, (MIN(rn) + MAX(rn)) / 2.0 AS avg_rank FROM (
      SELECT y_prob, y_true, ROW_NUMBER() OVER (ORDER BY y_prob, id) AS rn FROM {t}) r GROUP BY y_prob) g) x"""


@register("auc_roc", operators="E13 (rank-sum AUC, average ties)",
          sql=with_views(_AUC_SQL.format(t="scored", fb="0.0"), *_SC), doubles=["auc"])
def q_auc(spark, sf_dir):
    return ev.auc_roc(scored(spark, sf_dir))


@register("average_precision", operators="E13 (AP over distinct scores)",
          sql=with_views("""SELECT CASE WHEN (SELECT SUM(y_true) FROM scored) > 0 THEN
  SUM(pos * 1.0 / (SELECT SUM(y_true) FROM scored) * cpos / ccnt) ELSE 0.0 END AS average_precision FROM (
  SELECT pos, SUM(pos) OVER (ORDER BY s DESC) AS cpos, SUM(cnt) OVER (ORDER BY s DESC) AS ccnt FROM (
    SELECT y_prob AS s, SUM(y_true) AS pos, COUNT(*) AS cnt FROM scored GROUP BY y_prob) g) c""", *_SC),
          doubles=["average_precision"])
def q_ap(spark, sf_dir):
    return ev.average_precision(scored(spark, sf_dir))


@register("pr_auc", operators="E13 (trapezoid PR area, trainer variant)",
          sql=with_views("""WITH g AS (SELECT y_prob AS s, SUM(y_true) AS pos, COUNT(*) AS cnt FROM scored GROUP BY y_prob),
c AS (SELECT s, SUM(pos) OVER (ORDER BY s DESC) AS cpos, SUM(cnt) OVER (ORDER BY s DESC) AS ccnt,
             (SELECT SUM(y_true) FROM scored) AS P FROM g),
k AS (SELECT s, cpos * 1.0 / P AS rec, cpos * 1.0 / ccnt AS prec FROM c WHERE s >= (SELECT MAX(s) FROM c WHERE cpos = P)),
l AS (SELECT rec, prec, COALESCE(LAG(rec) OVER (ORDER BY s DESC), 0.0) AS rp, COALESCE(LAG(prec) OVER (ORDER BY s DESC), 1.0) AS pp FROM k)
SELECT COALESCE(SUM((rec - rp) * (prec + pp) / 2), 0.0) AS pr_auc FROM l""", *_SC), doubles=["pr_auc"])
def q_pr_auc(spark, sf_dir):
    return ev.pr_auc_trapezoid(scored(spark, sf_dir))


@register("temporal_auc", operators="E14 (AUC per normalised time window, mean)",
          sql=with_views("""WITH RECURSIVE w(wi, ws) AS (SELECT 0, CAST(0.0 AS DOUBLE) UNION ALL
    SELECT wi + 1, ws + CAST(0.1 AS DOUBLE) FROM w WHERE ws + CAST(0.1 AS DOUBLE) < 1.0),
sn AS (SELECT s.*, CASE WHEN m.mx > m.mn THEN (CAST(ts AS DOUBLE) - m.mn) / (m.mx - m.mn) ELSE CAST(ts AS DOUBLE) END AS tn
  FROM scored s CROSS JOIN (SELECT CAST(MIN(ts) AS DOUBLE) AS mn, CAST(MAX(ts) AS DOUBLE) AS mx FROM scored) m),
x AS (SELECT w.wi, sn.* FROM w JOIN sn ON sn.tn >= w.ws AND sn.tn <= LEAST(w.ws + 0.1, 1.0)),
r AS (SELECT wi, y_prob, y_true, ROW_NUMBER() OVER (PARTITION BY wi ORDER BY y_prob, id) AS rn FROM x),
g AS (SELECT wi, y_prob, SUM(y_true) AS pos, (MIN(rn) + MAX(rn)) / 2.0 AS ar FROM r GROUP BY wi, y_prob),
a AS (SELECT g.wi, (SUM(pos * ar) - MAX(t.P) * (MAX(t.P) + 1) / 2.0) / (MAX(t.P) * MAX(t.N)) AS auc
      FROM g JOIN (SELECT wi, SUM(y_true) AS P, SUM(1 - y_true) AS N FROM x GROUP BY wi) t ON g.wi = t.wi
      WHERE t.P > 0 AND t.N > 0 GROUP BY g.wi)
SELECT COALESCE(AVG(auc), 0.0) AS temporal_auc FROM a""", *_SC).replace("WITH scored AS", "WITH RECURSIVE scored AS", 1)
          .replace(",\nRECURSIVE w(", ",\nw(", 1).replace("WITH RECURSIVE w(", "w(", 1),
          doubles=["temporal_auc"])
def q_temporal_auc(spark, sf_dir):
    s = minmax_normalize(scored(spark, sf_dir), "ts", "tn")
    return ev.auc_per_time_window(s, "tn")


@register("top_k_metrics", operators="T2 (hits@k, precision@k, recall@k)",
          sql=with_views("""SELECT CAST(k.k AS BIGINT) AS k, CASE WHEN SUM(CASE WHEN r.rn <= k.k THEN r.y_true ELSE 0 END) > 0 THEN 1.0 ELSE 0.0 END
    / (SELECT COUNT(*) FROM scored) AS hits_at_k,
  SUM(CASE WHEN r.rn <= k.k THEN r.y_true ELSE 0 END) * 1.0 / k.k AS precision_at_k,
  SUM(CASE WHEN r.rn <= k.k THEN r.y_true ELSE 0 END) * 1.0 / (SELECT SUM(y_true) FROM scored) AS recall_at_k
FROM (SELECT y_true, ROW_NUMBER() OVER (ORDER BY y_prob DESC, id) AS rn FROM scored) r
CROSS JOIN (SELECT UNNEST([1, 5, 10, 20]) AS k) k GROUP BY k.k""", *_SC),
          doubles=["hits_at_k", "precision_at_k", "recall_at_k"])
def q_topk(spark, sf_dir):
    return ev.top_k_metrics(scored(spark, sf_dir)).withColumn("k", F.col("k").cast("long"))


@register("aggregate_runs", operators="G18 (mean, population std, min, max, median, count per metric)",
          sql=with_views("""WITH runs AS (SELECT account, AVG(CAST(y_pred = y_true AS DOUBLE)) AS accuracy, AVG(POW(y_prob - y_true, 2)) AS brier
  FROM scored GROUP BY account),
l AS (SELECT 'accuracy' AS metric, accuracy AS value FROM runs UNION ALL SELECT 'brier', brier FROM runs)
SELECT metric, AVG(value) AS mean, STDDEV_POP(value) AS std, MIN(value) AS min, MAX(value) AS max,
  CAST(COUNT(*) AS BIGINT) AS count, QUANTILE_CONT(value, 0.5) AS median FROM l GROUP BY metric""", *_SC),
          doubles=["mean", "std", "min", "max", "median"])
def q_runs(spark, sf_dir):
    s = scored(spark, sf_dir)
    runs = s.groupBy("account").agg(F.avg((F.col("y_pred") == F.col("y_true")).cast("double")).alias("accuracy"),
                                    F.avg((F.col("y_prob") - F.col("y_true")) ** 2).alias("brier"))
    return ev.aggregate_runs(runs, ["accuracy", "brier"])


@register("model_comparison", operators="E6 X13 X14 (per-model calibration table)",
          sql=with_views("""WITH m AS (
  SELECT 'raw' AS model, y_true, y_prob FROM scored
  UNION ALL SELECT 'temperature_2', y_true, 1.0 / (1.0 + EXP(-LN(LEAST(GREATEST(y_prob, 1e-15), 1 - 1e-15) / (1 - LEAST(GREATEST(y_prob, 1e-15), 1 - 1e-15))) / 2.0)) FROM scored
  UNION ALL SELECT 'minmax', y_true, CASE WHEN mx > mn THEN (y_prob - mn) / (mx - mn) ELSE 0.0 END
    FROM scored CROSS JOIN (SELECT MIN(y_prob) AS mn, MAX(y_prob) AS mx FROM scored) z)
SELECT a.*, g.ece, g.mce FROM (SELECT model, AVG(POW(y_prob - y_true, 2)) AS brier,
    -AVG(y_true * LN(LEAST(GREATEST(y_prob, 1e-15), 1 - 1e-15)) + (1 - y_true) * LN(1 - LEAST(GREATEST(y_prob, 1e-15), 1 - 1e-15))) AS log_loss,
    GREATEST(AVG(GREATEST(y_prob, 1 - y_prob)) - AVG(CAST(CAST(y_prob > 0.5 AS INTEGER) = y_true AS DOUBLE)), 0.0) AS overconfidence,
    VAR_POP(y_prob) AS sharpness FROM m GROUP BY model) a
JOIN (SELECT model, SUM(n * ABS(fp - mp)) / SUM(n) AS ece, MAX(ABS(fp - mp)) AS mce FROM (
    SELECT model, LEAST(FLOOR(y_prob * 10), 9) AS bin, COUNT(*) AS n, AVG(CAST(y_true AS DOUBLE)) AS fp, AVG(y_prob) AS mp FROM m GROUP BY 1, 2) b
  GROUP BY model) g ON g.model = a.model""", *_SC),
          doubles=["brier", "log_loss", "ece", "mce", "overconfidence", "sharpness"])
def q_models(spark, sf_dir):
    s = scored(spark, sf_dir).select("y_true", "y_prob")
    models = (s.withColumn("model", F.lit("raw"))
              .unionByName(s.withColumn("y_prob", temperature_scale(F.col("y_prob"), 2.0)).withColumn("model", F.lit("temperature_2")))
              .unionByName(ev.minmax_probability(s, "y_prob", "_p").withColumn("y_prob", F.col("_p")).drop("_p")
                           .withColumn("model", F.lit("minmax"))))
    return ev.model_calibration(models, "model")


_SPHERE_SQL = """ex AS (SELECT vec_id, label, d, CAST(x AS DOUBLE) AS x FROM (
    SELECT vec_id, label, UNNEST(range(0, len(embedding))) AS d, UNNEST(embedding) AS x FROM embeddings) u),
st AS (SELECT d, AVG(x) AS mu, STDDEV_POP(x) AS sd FROM ex GROUP BY d),
sc AS (SELECT ex.vec_id, MAX(ex.label) AS label,
         SUM(POW(CASE WHEN st.sd > 0 THEN (ex.x - st.mu) / st.sd ELSE 0.0 END, 2)) AS score
       FROM ex JOIN st ON ex.d = st.d GROUP BY ex.vec_id),
rad AS (SELECT QUANTILE_CONT(score, 0.95) AS radius FROM sc)"""


def _sphere(spark, sf_dir):
    return ev.sphere_scores(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.05)


@register("sphere_scores", operators="K3 (standardise, squared distance to centre, (1-nu) radius)",
          sql=with_views("SELECT vec_id, score, radius, score > radius AS is_outlier FROM sc CROSS JOIN rad",
                         extra=[_SPHERE_SQL]), doubles=["score", "radius"])
def q_sphere(spark, sf_dir):
    return _sphere(spark, sf_dir)


@register("sphere_losses", operators="K4 (Huber-like loss with lower-median delta, soft boundary)",
          sql=with_views("""SELECT AVG(CASE WHEN score <= dl THEN 0.5 * score ELSE dl * (SQRT(score) - 0.5 * SQRT(dl)) END) AS robust_loss,
  AVG(GREATEST(score - radius, 0.0)) AS soft_boundary_loss
FROM sc CROSS JOIN rad CROSS JOIN (SELECT QUANTILE_DISC(score, 0.5) AS dl FROM sc) m""", extra=[_SPHERE_SQL]),
          doubles=["robust_loss", "soft_boundary_loss"])
def q_sphere_losses(spark, sf_dir):
    return ev.sphere_losses(_sphere(spark, sf_dir))


@register("percentile_threshold_eval", operators="E15 X14 (95th percentile threshold, flags, metrics)",
          sql=with_views("""SELECT threshold,
  (tp + tn) * 1.0 / (tp + fp + fn + tn) AS accuracy, CASE WHEN tp + fp > 0 THEN tp * 1.0 / (tp + fp) ELSE 0.0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp * 1.0 / (tp + fn) ELSE 0.0 END AS recall
FROM (SELECT MAX(t.threshold) AS threshold,
        SUM(CASE WHEN score > t.threshold AND label = 0 THEN 1 ELSE 0 END) AS tp, SUM(CASE WHEN score > t.threshold AND label <> 0 THEN 1 ELSE 0 END) AS fp,
        SUM(CASE WHEN score <= t.threshold AND label = 0 THEN 1 ELSE 0 END) AS fn, SUM(CASE WHEN score <= t.threshold AND label <> 0 THEN 1 ELSE 0 END) AS tn
      FROM sc CROSS JOIN (SELECT QUANTILE_CONT(score, 0.95) AS threshold FROM sc) t) c""", extra=[_SPHERE_SQL]),
          doubles=["threshold", "accuracy", "precision", "recall"])
def q_pct_eval(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    s = ev.sphere_scores(e, "vec_id", "embedding").join(e.select("vec_id", "label"), "vec_id") \
        .withColumn("y", (F.col("label") == 0).cast("int")).drop("radius")
    return ev.percentile_threshold_eval(s, "score", "y", 95.0).select("threshold", "accuracy", "precision", "recall")
