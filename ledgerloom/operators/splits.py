"""Train/test splitting and leakage checks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import draw60
from ..plans.ordering import with_global_rank


def split_by_ratio(df: DataFrame, ts_col: str, tie_col: str, train_ratio: float = 0.8) -> DataFrame:
    """First floor(n * ratio) rows in (ts, tie) order are 'train', the rest 'test'.
    Equal timestamps may land on both sides (D17); Q6 reports it.  The rank is computed by a
    range shuffle, not a single-partition window."""
    r = with_global_rank(df, [ts_col, tie_col], "_rank")
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    return (r.crossJoin(F.broadcast(n))
            .withColumn("split", F.when(F.col("_rank") < F.floor(F.col("_n") * F.lit(train_ratio)), "train")
                        .otherwise("test")).drop("_n"))


def split_by_cutoff(df: DataFrame, ts_col: str, cutoff) -> DataFrame:
    """Ts < cutoff -> train, else test."""
    return df.withColumn("split", F.when(F.col(ts_col) < F.lit(cutoff), "train").otherwise("test"))


def split_three_way(df: DataFrame, ts_col: str, tie_col: str, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """floor(n*train) rows train, next floor(n*val) val, rest test, in time order."""
    r = with_global_rank(df, [ts_col, tie_col], "_rank")
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    a = F.floor(F.col("_n") * F.lit(train))
    b = a + F.floor(F.col("_n") * F.lit(val))
    return (r.crossJoin(F.broadcast(n))
            .withColumn("split", F.when(F.col("_rank") < a, "train").when(F.col("_rank") < b, "val").otherwise("test"))
            .drop("_n"))


def key_fields(df: DataFrame, key_col: str) -> list[Column]:
    """The key column, or the fields of a struct key."""
    kind = df.schema[key_col].dataType
    return [F.col(f"{key_col}.{f}") for f in kind.fieldNames()] if isinstance(kind, T.StructType) else [F.col(key_col)]


def random_split(df: DataFrame, key_col: str, ratios: dict[str, float], seed: int = 42) -> DataFrame:
    """Stable hash split; ratios must sum to 1.  u = hash(key fields, seed) in [0, 1)."""
    if abs(sum(ratios.values()) - 1.0) > 1e-9:
        raise ValueError("ratios must sum to 1")
    u = F.pmod(draw60(*key_fields(df, key_col), F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    expr, acc = None, 0.0
    items = list(ratios.items())
    for i, (name, r) in enumerate(items):
        acc += r
        cond = u < F.lit(acc) if i < len(items) - 1 else F.lit(True)
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return df.withColumn("split", expr)


def kfold(df: DataFrame, key_col: str, k: int = 5, seed: int = 42) -> DataFrame:
    """fold = hash(key fields, seed) mod k."""
    return df.withColumn("fold", F.pmod(draw60(*key_fields(df, key_col), F.lit(seed)), F.lit(k)).cast("int"))


def kfold_time_blocked(df: DataFrame, ts_col: str, tie_col: str, k: int = 5) -> DataFrame:
    """N13 time-blocked: fold = floor(rank * k / n) in (ts, tie) order (contiguous blocks)."""
    r = with_global_rank(df, [ts_col, tie_col], "_rank")
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    return r.crossJoin(F.broadcast(n)).withColumn(
        "fold", F.floor(F.col("_rank") * k / F.col("_n")).cast("int")).drop("_n", "_rank")


def split_overlap(split: DataFrame, ts_col: str) -> DataFrame:
    """Q6: one row: train_max, test_min, overlap = train_max >= test_min (empty side passes)."""
    return split.agg(F.max(F.when(F.col("split") == "train", F.col(ts_col))).alias("train_max"),
                     F.min(F.when(F.col("split") == "test", F.col(ts_col))).alias("test_min")) \
        .withColumn("overlap", F.coalesce(F.col("train_max") >= F.col("test_min"), F.lit(False)))


def feature_leakage(df: DataFrame, ts_col: str, order_col: str, feature_cols: list[str]) -> DataFrame:
    """Q7: one row per finding: 'unsorted_time' = number of rows whose ts is below the previous
    row's ts in ingest order (lag over a chunked global order), and 'constant:<col>' for every
    column with at most one distinct value counting null (one aggregate for all columns)."""
    from ..plans.ordering import windowed
    lagged = windowed(df.select(order_col, ts_col), [], [order_col], 1, 0,
                      lambda w: [F.lag(ts_col).over(w).alias("_prev")])
    unsorted = lagged.agg(F.sum(F.when(F.col(ts_col) < F.col("_prev"), 1).otherwise(0)).cast("long")
                          .alias("n")).select(F.lit("unsorted_time").alias("check"), "n")
    consts = df.agg(*[(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in feature_cols])
    long_ = consts.unpivot([], feature_cols, "column", "distinct_values") \
        .where(F.col("distinct_values") <= 1) \
        .select(F.concat(F.lit("constant:"), F.col("column")).alias("check"), F.lit(1).cast("long").alias("n"))
    return unsorted.unionByName(long_)


def target_leakage(df: DataFrame, target_col: str, feature_cols: list[str], threshold: float = 0.95) -> DataFrame:
    """Q8: |Pearson(feature, target)| for every feature in one aggregate; leak when above the
    threshold; zero-variance (null correlation) columns are skipped."""
    agg = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target_col).cast("double")).alias(c) for c in feature_cols])
    long_ = agg.unpivot([], feature_cols, "feature", "corr").where(F.col("corr").isNotNull() & ~F.isnan("corr"))
    return long_.withColumn("abs_corr", F.abs("corr")).withColumn("leak", F.col("abs_corr") > threshold)
