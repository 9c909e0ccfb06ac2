"""Evaluation: calibration (E1-E7), classification / link / anomaly / regression metrics
(E8-E11), AUC and average precision (E13, E14), percentile thresholds (E15), ranking at k (T2),
run aggregates (G18), one-class scoring (K3, K4, X14).

Scored input: ``(id, y_true in {0,1}, y_prob)``; ``id`` breaks ties so every order is total.
All metrics are aggregates; orders over all rows use the range-partitioned helpers.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordering import exact_percentiles, grouped_percentiles, with_cumulative_sums, with_global_rank
from ..session import cut_lineage

EPS = 1e-15


def with_bins(df: DataFrame, prob_col: str = "y_prob", n_bins: int = 10) -> DataFrame:
    """Uniform bin = least(floor(p * n), n - 1), so p = 1 lands in the last bin."""
    return df.withColumn("bin", F.least(F.floor(F.col(prob_col) * n_bins), F.lit(n_bins - 1)).cast("int"))


def calibration_curve(df: DataFrame, y_col: str = "y_true", prob_col: str = "y_prob",
                      n_bins: int = 10, strategy: str = "uniform") -> DataFrame:
    """Per non-empty bin: fraction of positives, mean predicted probability, count.

    ``uniform``: bin = least(floor(p n), n - 1).  ``quantile``: edges are the linear
    percentiles 0, 1/n, ..., 1 of p and bin = number of inner edges strictly below p."""
    if strategy == "quantile":
        edges = exact_percentiles(df, prob_col, {f"q{i}": i / n_bins for i in range(1, n_bins)})
        cnt = None
        for i in range(1, n_bins):
            term = (F.col(prob_col) > F.col(f"q{i}")).cast("int")
            cnt = term if cnt is None else cnt + term
        b = df.crossJoin(F.broadcast(edges)).withColumn("bin", cnt)
    elif strategy == "uniform":
        b = with_bins(df, prob_col, n_bins)
    else:
        raise ValueError("strategy must be uniform or quantile")
    return b.groupBy("bin").agg(F.avg(F.col(y_col).cast("double")).alias("fraction_positive"),
                                F.avg(prob_col).alias("mean_predicted"), F.count(F.lit(1)).alias("n"))


def calibration_errors(df: DataFrame, y_col: str = "y_true", prob_col: str = "y_prob",
                       n_bins: int = 10) -> DataFrame:
    """E2 + E4: Brier, log loss (clip 1e-15), ECE, MCE, over/under-confidence, sharpness."""
    y = F.col(y_col).cast("double")
    p = F.col(prob_col).cast("double")
    pc = F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))
    base = df.agg(
        F.avg((p - y) ** 2).alias("brier"),
        (-F.avg(y * F.log(pc) + (1 - y) * F.log(1 - pc))).alias("log_loss"),
        F.avg(F.greatest(p, 1 - p)).alias("_conf"),
        F.avg(((p > 0.5).cast("double") == y).cast("double")).alias("_acc"),
        F.var_pop(p).alias("sharpness"), F.count(F.lit(1)).alias("_n"))
    curve = calibration_curve(df, y_col, prob_col, n_bins)
    gaps = curve.select((F.col("n") * F.abs(F.col("fraction_positive") - F.col("mean_predicted"))).alias("_w"),
                        F.abs(F.col("fraction_positive") - F.col("mean_predicted")).alias("_g"))
    eg = gaps.agg(F.sum("_w").alias("_sw"), F.max("_g").alias("mce"))
    return (base.crossJoin(eg)
            .select("brier", "log_loss", (F.col("_sw") / F.col("_n")).alias("ece"), "mce",
                    F.greatest(F.col("_conf") - F.col("_acc"), F.lit(0.0)).alias("overconfidence"),
                    F.greatest(F.col("_acc") - F.col("_conf"), F.lit(0.0)).alias("underconfidence"),
                    "sharpness"))


def model_calibration(df: DataFrame, model_col: str, y_col: str = "y_true", prob_col: str = "y_prob",
                      n_bins: int = 10) -> DataFrame:
    """Per model Brier, log loss, ECE, MCE, overconfidence and sharpness, from one aggregate per
    (model, bin)."""
    y, p = F.col(y_col).cast("double"), F.col(prob_col).cast("double")
    pc = F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))
    per = with_bins(df, prob_col, n_bins).groupBy(model_col, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("_y"), F.sum(p).alias("_p"), F.sum(p * p).alias("_pp"),
        F.sum((p - y) ** 2).alias("_b"), F.sum(y * F.log(pc) + (1 - y) * F.log(1 - pc)).alias("_l"),
        F.sum(F.greatest(p, 1 - p) - ((p > 0.5).cast("double") == y).cast("double")).alias("_o"))
    gap = F.abs(F.col("_y") - F.col("_p"))
    n = F.sum("n")
    return per.groupBy(model_col).agg(
        (F.sum("_b") / n).alias("brier"), (-F.sum("_l") / n).alias("log_loss"), (F.sum(gap) / n).alias("ece"),
        F.max(gap / F.col("n")).alias("mce"), F.greatest(F.sum("_o") / n, F.lit(0.0)).alias("overconfidence"),
        (F.sum("_pp") / n - (F.sum("_p") / n) ** 2).alias("sharpness"))


def calibration_report(df: DataFrame, y_col: str = "y_true", prob_col: str = "y_prob",
                       n_bins: int = 10) -> DataFrame:
    """E5: the errors, ratings of Brier score and ECE, and advice codes (comma separated) by the
    report's fixed thresholds."""
    # Rating limits (excellent, good, fair) and advice thresholds of the report.
    rate = lambda c, a, b, f: (F.when(F.col(c) < a, "excellent").when(F.col(c) < b, "good")
                               .when(F.col(c) < f, "fair").otherwise("poor"))
    advice = [(F.col("brier") > 0.25, "improve_discrimination"), (F.col("ece") > 0.05, "apply_calibration"),
              (F.col("overconfidence") > 0.1, "overconfident"), (F.col("underconfidence") > 0.1, "underconfident"),
              (F.col("sharpness") < 0.05, "low_sharpness")]
    return calibration_errors(df, y_col, prob_col, n_bins).select(
        "ece", "mce", "brier", "log_loss", "overconfidence", "underconfidence", "sharpness",
        rate("brier", 0.1, 0.2, 0.35).alias("brier_rating"), rate("ece", 0.01, 0.05, 0.1).alias("ece_rating"),
        F.concat_ws(",", *[F.when(c, F.lit(a)) for c, a in advice]).alias("advice"))


def adaptive_calibration_error(df: DataFrame, y_col: str = "y_true", prob_col: str = "y_prob",
                               n_bins: int = 10) -> DataFrame:
    """ACE over quantile bins [q_i, q_{i+1}) (q linear); the maximum row falls in no bin;
    weight n_bin / N."""
    qs = {f"q{i}": i / n_bins for i in range(n_bins + 1)}
    edges = exact_percentiles(df, prob_col, qs)
    x = df.crossJoin(F.broadcast(edges))
    p = F.col(prob_col)
    b = None
    for i in range(n_bins):
        cond = (p >= F.col(f"q{i}")) & (p < F.col(f"q{i + 1}"))
        b = F.when(cond, F.lit(i)) if b is None else b.when(cond, F.lit(i))
    x = x.withColumn("_b", b)
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    per = x.where(F.col("_b").isNotNull()).groupBy("_b").agg(
        F.count(F.lit(1)).alias("_c"), F.avg(F.col(y_col).cast("double")).alias("_a"), F.avg(p).alias("_m"))
    return per.crossJoin(F.broadcast(n)).agg(
        F.sum(F.col("_c") / F.col("_n") * F.abs(F.col("_a") - F.col("_m"))).alias("ace"))


def threshold_sweep(df: DataFrame, y_col: str = "y_true", prob_col: str = "y_prob",
                    start: float = 0.1, stop: float = 0.9, step: float = 0.05) -> DataFrame:
    """Thresholds start + i*step < stop: precision, recall, F1 and |mean p - positive rate|
    above the threshold.

    One pass, no row multiplication: every row falls in the bucket of the largest threshold
    <= p (a CASE over the sorted thresholds); bucket sums (one row per threshold) are then
    accumulated from the top, so "p >= t" counts are suffix sums over <= 17 rows."""
    n = 0
    ts = []
    while start + n * step < stop:
        ts.append(start + n * step)
        n += 1
    p = F.col(prob_col)
    bucket = F.lit(-1)
    for i, t in enumerate(ts):
        bucket = F.when(p >= F.lit(t), F.lit(i)).otherwise(bucket)
    y = F.col(y_col).cast("long")
    g = df.groupBy(bucket.alias("i")).agg(F.count(F.lit(1)).alias("_n"), F.sum(y).alias("_pos"),
                                          F.sum(p).alias("_sp"))
    tot = df.agg(F.sum(y).alias("_P"))
    th = df.sparkSession.createDataFrame(list(enumerate(ts)), "i int, threshold double")
    # suffix sums over the (<= len(ts) + 1)-row bucket table
    from pyspark.sql import Window
    w = Window.orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    cum = g.select("i", F.sum("_n").over(w).alias("_ge"), F.sum("_pos").over(w).alias("tp"),
                   F.sum("_sp").over(w).alias("_sp_ge"))
    # a threshold takes the suffix sums of the first non-empty bucket at or above it
    x = th.crossJoin(F.broadcast(tot)).join(cum.select(F.col("i").alias("_j"), F.col("_ge").alias("_ge2"), F.col("tp").alias("_tp2"),
                          F.col("_sp_ge").alias("_sp2")), F.col("_j") >= F.col("i"), "left") \
         .groupBy("i", "threshold", "_P").agg(F.max_by("_ge2", F.struct(-F.col("_j"))).alias("_ge"),
                                              F.max_by("_tp2", F.struct(-F.col("_j"))).alias("tp"),
                                              F.max_by("_sp2", F.struct(-F.col("_j"))).alias("_sp_ge")) \
         .fillna({"_ge": 0, "tp": 0, "_sp_ge": 0.0})
    prec = F.when(F.col("_ge") > 0, F.col("tp") / F.col("_ge")).otherwise(0.0)
    rec = F.when(F.col("_P") > 0, F.col("tp") / F.col("_P")).otherwise(0.0)
    cal = F.when(F.col("_ge") > 0, F.abs(F.col("_sp_ge") / F.col("_ge") - F.col("tp") / F.col("_ge"))).otherwise(0.0)
    out = x.select("threshold", prec.alias("precision"), rec.alias("recall"), cal.alias("calibration_error"))
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                       2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
                          .otherwise(0.0))


def best_threshold(sweep: DataFrame, max_calibration_error: float = 0.1) -> DataFrame:
    """The threshold with the best F1 among those with calibration error < bound."""
    return sweep.where(F.col("calibration_error") < max_calibration_error) \
        .agg(F.max_by("threshold", F.struct("f1", F.col("threshold"))).alias("threshold"), F.max("f1").alias("f1"))


def confusion(df: DataFrame, y_col: str = "y_true", pred_col: str = "y_pred") -> DataFrame:
    """Confusion counts tp, fp, fn, tn (one row)."""
    y, p = F.col(y_col).cast("int"), F.col(pred_col).cast("int")
    return df.agg(F.sum(((p == 1) & (y == 1)).cast("long")).alias("tp"),
                  F.sum(((p == 1) & (y == 0)).cast("long")).alias("fp"),
                  F.sum(((p == 0) & (y == 1)).cast("long")).alias("fn"),
                  F.sum(((p == 0) & (y == 0)).cast("long")).alias("tn"))


def _safe(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def binary_metrics(df: DataFrame, y_col: str = "y_true", pred_col: str = "y_pred") -> DataFrame:
    """E9/E10 core: accuracy, precision, recall, F1 of the positive class, FPR, FNR, detection rate."""
    c = confusion(df, y_col, pred_col)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    out = c.select(_safe(tp + tn, tp + fp + fn + tn).alias("accuracy"), _safe(tp, tp + fp).alias("precision"),
                   _safe(tp, tp + fn).alias("recall"), _safe(fp, fp + tn).alias("false_positive_rate"),
                   _safe(fn, fn + tp).alias("false_negative_rate"), _safe(tp, tp + fn).alias("detection_rate"))
    return out.withColumn("f1", _safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def classification_metrics(df: DataFrame, y_col: str = "y_true", pred_col: str = "y_pred") -> DataFrame:
    """Accuracy and support-weighted precision / recall / F1 over the classes present,
    plus per-class rows.  Everything derives from the confusion table (one row per
    (true, predicted) pair present) - no cross join of rows with the class list."""
    conf = df.groupBy(F.col(y_col).alias("_y"), F.col(pred_col).alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    support = conf.groupBy(F.col("_y").alias("label")).agg(F.sum("_c").alias("support"))
    predicted = conf.groupBy(F.col("_p").alias("label")).agg(F.sum("_c").alias("_pred"))
    tp = conf.where(F.col("_y") == F.col("_p")).select(F.col("_y").alias("label"), F.col("_c").alias("_tp"))
    per = support.join(predicted, "label", "left").join(tp, "label", "left").fillna({"_pred": 0, "_tp": 0})
    per = per.select(F.col("label").cast("string").alias("class"),
                     _safe(F.col("_tp"), F.col("_pred")).alias("precision"),
                     _safe(F.col("_tp"), F.col("support")).alias("recall"), "support")
    per = per.withColumn("f1", _safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    acc = df.agg(F.avg((F.col(y_col) == F.col(pred_col)).cast("double")).alias("accuracy"))
    w = per.agg(F.lit("weighted").alias("class"),
                *[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m) for m in ("precision", "recall", "f1")],
                F.sum("support").alias("support")).crossJoin(acc)
    return per.withColumn("accuracy", F.lit(None).cast("double")).unionByName(w)


def regression_metrics(df: DataFrame, y_col: str, pred_col: str) -> DataFrame:
    """MSE, RMSE, MAE, R2 (0 when y is constant), MAPE in percent.  A row with y = 0 makes
    MAPE infinite (NaN if the prediction is 0 too); it is infinite when all y are 0."""
    y, p = F.col(y_col).cast("double"), F.col(pred_col).cast("double")
    g = df.agg(F.avg((y - p) ** 2).alias("mse"), F.avg(F.abs(y - p)).alias("mae"),
               F.sum((y - p) ** 2).alias("_ssr"), F.var_pop(y).alias("_vy"), F.count(F.lit(1)).alias("_n"),
               F.max((y != 0).cast("int")).alias("_some"),
               F.avg(F.when(y != 0, F.abs((y - p) / F.when(y != 0, y)))
                     .when(p == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).alias("_mape"))
    return g.select("mse", F.sqrt("mse").alias("rmse"), "mae",
                    F.when(F.col("_vy") > 0, 1 - F.col("_ssr") / (F.col("_vy") * F.col("_n"))).otherwise(0.0).alias("r2"),
                    F.when(F.col("_some") == 1, F.col("_mape") * 100).otherwise(F.lit(float("inf"))).alias("mape"))


def auc_roc(df: DataFrame, y_col: str = "y_true", score_col: str = "y_prob", id_col: str = "id",
            group_cols: list[str] = (), fallback: float = 0.0) -> DataFrame:
    """ROC AUC by the rank-sum formula with average ranks for ties.

    Rows get a global rank in (group, score, id) order (range-partitioned); per (group, score)
    the average rank is (min + max) / 2 relative to the group's first rank.  One class only ->
    ``fallback``."""
    keys = list(group_cols)
    r = with_global_rank(df.select(*keys, F.col(score_col).alias("_s"), F.col(y_col).cast("int").alias("_y"),
                                   F.col(id_col).alias("_id")), [*keys, "_s", "_id"], "_g")
    first = r.groupBy(*keys).agg(F.min("_g").alias("_g0"), F.sum("_y").alias("_P"),
                                 F.sum(1 - F.col("_y")).alias("_N"))
    ties = r.groupBy(*keys, "_s").agg(F.min("_g").alias("_lo"), F.max("_g").alias("_hi"), F.sum("_y").alias("_pos"))
    t = ties.join(first, keys) if keys else ties.crossJoin(first)
    avg_rank = (F.col("_lo") + F.col("_hi")) / 2 - F.col("_g0") + 1
    g = t.groupBy(*keys).agg(F.sum(F.col("_pos") * avg_rank).alias("_rs"), F.first("_P").alias("_P"),
                             F.first("_N").alias("_N"))
    auc = F.when((F.col("_P") > 0) & (F.col("_N") > 0),
                 (F.col("_rs") - F.col("_P") * (F.col("_P") + 1) / 2) / (F.col("_P") * F.col("_N"))
                 ).otherwise(F.lit(fallback))
    return g.select(*keys, auc.alias("auc"))


def _score_groups(df: DataFrame, y_col: str, score_col: str) -> DataFrame:
    """Distinct scores descending with positives, count, and cumulative TP / count at >= s."""
    g = df.groupBy(F.col(score_col).alias("_s")).agg(F.sum(F.col(y_col).cast("long")).alias("_pos"),
                                                     F.count(F.lit(1)).alias("_cnt"))
    return with_cumulative_sums(g, [F.col("_s").desc()], ["_pos", "_cnt"])


def average_precision(df: DataFrame, y_col: str = "y_true", score_col: str = "y_prob") -> DataFrame:
    """AP = sum over distinct scores (descending) of (R_k - R_{k-1}) * P_k."""
    c = _score_groups(df, y_col, score_col)
    P = df.agg(F.sum(F.col(y_col).cast("long")).alias("_P"))
    return c.crossJoin(F.broadcast(P)).agg(
        F.when(F.first("_P") > 0, F.sum(F.col("_pos") / F.col("_P") * F.col("cum__pos") / F.col("cum__cnt")))
        .otherwise(F.lit(0.0)).alias("average_precision"))


def pr_auc_trapezoid(df: DataFrame, y_col: str = "y_true", score_col: str = "y_prob") -> DataFrame:
    """E13 (trainer variant): trapezoid area under the precision-recall points, points taken at
    distinct scores descending until full recall, plus the (recall 0, precision 1) start."""
    c = _score_groups(df, y_col, score_col)
    P = df.agg(F.sum(F.col(y_col).cast("long")).alias("_P"))
    c = c.crossJoin(F.broadcast(P)).select(
        "_s", (F.col("cum__pos") / F.col("_P")).alias("rec"), (F.col("cum__pos") / F.col("cum__cnt")).alias("prec"),
        "cum__pos", "_P")
    # keep points up to the first one reaching full recall
    first_full = c.where(F.col("cum__pos") == F.col("_P")).agg(F.max("_s").alias("_sfull"))
    c = c.crossJoin(F.broadcast(first_full)).where(F.col("_s") >= F.col("_sfull"))
    r = with_global_rank(c.select("_s", "rec", "prec"), [F.col("_s").desc()], "_k")
    prev = r.select((F.col("_k") + 1).alias("_k"), F.col("rec").alias("_rp"), F.col("prec").alias("_pp"))
    j = r.join(prev, "_k", "left").select(
        "rec", "prec", F.coalesce("_rp", F.lit(0.0)).alias("_rp"), F.coalesce("_pp", F.lit(1.0)).alias("_pp"))
    return j.agg(F.coalesce(F.sum((F.col("rec") - F.col("_rp")) * (F.col("prec") + F.col("_pp")) / 2), F.lit(0.0))
                 .alias("pr_auc"))


def auc_per_time_window(df: DataFrame, t_col: str, y_col: str = "y_true", score_col: str = "y_prob",
                        id_col: str = "id", window: float = 0.1) -> DataFrame:
    """AUC per normalised-time window [s, min(s + w, 1)] (s = 0, w, 2w, ... < 1; inclusive,
    so boundary rows count in two windows); windows with one class are skipped; mean of the
    rest (0 when none)."""
    starts, s = [], 0.0
    while s < 1.0:
        starts.append(s)
        s += window
    ends = [min(s + window, 1.0) for s in starts]
    # a row's window number and the one before it, as far as their bounds hold it: two rows at most
    number = F.floor(F.col(t_col) / window).cast("int")
    inside = lambda k: (F.col(t_col) >= F.get(F.lit(starts), k)) & (F.col(t_col) <= F.get(F.lit(ends), k))
    near = F.filter(F.sequence(number - 1, number + 1), lambda k: F.coalesce(inside(k), F.lit(False)))
    x = df.select("*", F.explode(near).alias("w"))
    a = auc_roc(x, y_col, score_col, id_col, ["w"], fallback=-1.0)
    return a.where(F.col("auc") >= 0).agg(F.coalesce(F.avg("auc"), F.lit(0.0)).alias("temporal_auc"))


def percentile_threshold_eval(df: DataFrame, score_col: str, y_col: str, pct: float = 95.0) -> DataFrame:
    """threshold = linear percentile of the scores; flag = score > threshold; confusion
    metrics of the flags."""
    df = cut_lineage(df.select(score_col, y_col))         # the scores are computed once
    th = exact_percentiles(df, score_col, {"threshold": pct / 100.0})
    x = df.crossJoin(F.broadcast(th)).withColumn("_flag", (F.col(score_col) > F.col("threshold")).cast("int"))
    return binary_metrics(x, y_col, "_flag").crossJoin(th)


def top_k_metrics(df: DataFrame, y_col: str = "y_true", score_col: str = "y_prob", id_col: str = "id",
                  ks: list[int] = (1, 5, 10, 20)) -> DataFrame:
    """hits@k (any positive in the top k, divided by the number of rows, as the reference
    computes it), precision@k and recall@k.  Top k by score (ties by id) with ``orderBy.limit``,
    which Spark runs as a per-partition top-k merge (TakeOrderedAndProject)."""
    kmax = max(ks)
    top = df.orderBy(F.col(score_col).desc(), F.col(id_col)).limit(kmax) \
        .select(F.col(y_col).cast("long").alias("_y"), F.col(score_col).alias("_s"), F.col(id_col).alias("_id"))
    # at most max(ks) rows remain, so this window is bounded
    r = top.withColumn("_r", F.row_number().over(Window.orderBy(F.col("_s").desc(), F.col("_id"))))
    tot = df.agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(y_col).cast("long")).alias("_P"))
    ks_df = df.sparkSession.createDataFrame([(k,) for k in ks], "k int")
    j = ks_df.crossJoin(r).where(F.col("_r") <= F.col("k")).groupBy("k").agg(F.sum("_y").alias("_h"))
    return j.crossJoin(tot).select(
        "k", (F.when(F.col("_h") > 0, 1.0).otherwise(0.0) / F.col("_n")).alias("hits_at_k"),
        (F.col("_h") / F.col("k")).alias("precision_at_k"),
        F.when(F.col("_P") > 0, F.col("_h") / F.col("_P")).otherwise(0.0).alias("recall_at_k"))


def aggregate_runs(runs: DataFrame, metric_cols: list[str]) -> DataFrame:
    """Per metric over runs: mean, population std, min, max, exact median, count; NaN and
    null ignored."""
    long_ = runs.unpivot([], metric_cols, "metric", "value").where(
        F.col("value").isNotNull() & ~F.isnan("value"))
    base = long_.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
                                       F.min("value").alias("min"), F.max("value").alias("max"),
                                       F.count(F.lit(1)).alias("count"))
    return base.join(grouped_percentiles(long_, "metric", "value", {"median": 0.5}), "metric", "left")


def minmax_probability(df: DataFrame, score_col: str, out: str = "fraud_probability") -> DataFrame:
    """Global min-max of scores to [0, 1]; constant scores -> 0."""
    mm = df.agg(F.min(score_col).alias("_mn"), F.max(score_col).alias("_mx"))
    return df.crossJoin(F.broadcast(mm)).withColumn(
        out, F.when(F.col("_mx") > F.col("_mn"), (F.col(score_col) - F.col("_mn")) / (F.col("_mx") - F.col("_mn")))
        .otherwise(F.lit(0.0))).drop("_mn", "_mx")


def sphere_scores(vectors: DataFrame, id_col: str, vec_col: str, nu: float = 0.05) -> DataFrame:
    """K3 (re-aimed one-class sphere): standardise every dimension (population std, as a
    standard scaler; 0-variance dims -> 0), centre = mean (0 after scaling), score = squared
    distance to the centre, radius = linear (1 - nu) quantile of the scores, outlier = score > radius.

    Per-dimension statistics are one grouped aggregate (combined map-side) that ends as one row
    with an array, one entry per vector dimension; rows are scored in place, without a shuffle."""
    ex = vectors.select(F.posexplode(vec_col).alias("d", "x")).withColumn("x", F.col("x").cast("double"))
    st = ex.groupBy("d").agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd"))
    st = st.agg(F.array_sort(F.collect_list(F.struct("d", "mu", "sd"))).alias("_st"))
    z = F.zip_with(F.col(vec_col), F.col("_st"), lambda x, s: F.when(s["sd"] > 0, (x.cast("double") - s["mu"]) / s["sd"]).otherwise(0.0))
    sc = vectors.crossJoin(F.broadcast(st)).select(
        id_col, F.aggregate(z, F.lit(0.0), lambda a, x: a + x * x).alias("score"))
    rad = exact_percentiles(sc, "score", {"radius": 1 - nu})
    return sc.crossJoin(F.broadcast(rad)).withColumn("is_outlier", F.col("score") > F.col("radius"))


def sphere_losses(scores: DataFrame, score_col: str = "score", radius_col: str = "radius") -> DataFrame:
    """K4: robust Huber-like loss with delta = lower median of the distances, and the soft
    boundary loss mean(relu(d - R))."""
    delta = exact_percentiles(scores, score_col, {"_delta": 0.5}, interpolation="lower")
    d = F.col(score_col)
    x = scores.crossJoin(F.broadcast(delta))
    robust = F.when(d <= F.col("_delta"), 0.5 * d).otherwise(F.col("_delta") * (F.sqrt(d) - 0.5 * F.sqrt("_delta")))
    return x.agg(F.avg(robust).alias("robust_loss"),
                 F.avg(F.greatest(d - F.col(radius_col), F.lit(0.0))).alias("soft_boundary_loss"))
