"""Encodings and augmentation for model inputs (X8-X12).  Vocabularies are built by Spark
(distinct values + range-partitioned rank), never collected to the driver."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import age_weighted_keep, time_encoding, time_noise, uniform
from ..plans.ordering import with_global_rank


def asset_vocabulary(df: DataFrame, asset_col: str = "asset") -> DataFrame:
    """Sorted distinct assets -> index 0..k-1."""
    d = df.select(F.col(asset_col).alias("asset")).where(F.col("asset").isNotNull()).distinct()
    return with_global_rank(d, ["asset"], "index")


def one_hot_assets(df: DataFrame, vocab: DataFrame, asset_col: str = "asset") -> DataFrame:
    """Index of each row's asset (unknown -> 0, the reference's quirk) and a one-hot array
    of vocabulary length."""
    k = vocab.agg(F.count(F.lit(1)).alias("_k"))
    x = df.join(vocab.withColumnRenamed("asset", asset_col), asset_col, "left").crossJoin(F.broadcast(k)) \
        .withColumn("index", F.coalesce(F.col("index"), F.lit(0)))
    onehot = F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda i: F.when(i == F.col("index"), 1.0).otherwise(0.0))
    return x.withColumn("one_hot", onehot).drop("_k")


def sparse_one_hot(df: DataFrame, vocab: DataFrame, asset_col: str = "asset") -> DataFrame:
    """X8 as a sparse vector: ``one_hot`` = struct(size, indices, values) with one entry (unknown -> index
    0), so a row is as wide for a million assets as for ten.  The vocabulary is joined, not broadcast
    by hand; its size is one number."""
    size = vocab.count()
    x = df.join(vocab.withColumnRenamed("asset", asset_col), asset_col, "left")
    x = x.withColumn("index", F.coalesce("index", F.lit(0).cast("long")))
    return x.withColumn("one_hot", F.struct(F.lit(size).cast("long").alias("size"), F.array("index").alias("indices"),
                                            F.array(F.lit(1.0)).alias("values")))


def sparse_dot(df: DataFrame, weights: DataFrame, vector_col: str = "one_hot", out_col: str = "dot") -> DataFrame:
    """Dot product of a sparse vector column with weights(index, weight), by a join on the index; every
    row of ``df`` keeps its columns.  Only entries travel, never whole vectors."""
    key = F.monotonically_increasing_id()
    rows = df.withColumn("_at", key) if "_at" not in df.columns else df
    flat = rows.select("*", F.explode(F.arrays_zip(F.col(f"{vector_col}.indices").alias("i"),
                                                   F.col(f"{vector_col}.values").alias("v"))).alias("_e"))
    w = weights.select(F.col("index").alias("_i"), "weight")
    one = flat.join(w, F.col("_e.i") == F.col("_i"), "left")
    return one.groupBy(*rows.columns).agg(F.sum(F.col("_e.v") * F.coalesce("weight", F.lit(0.0))).alias(out_col)).drop("_at")


def embedding_lookup(indexed: DataFrame, table: DataFrame, index_col: str = "index", id_col: str = "vec_id",
                     vec_col: str = "embedding") -> DataFrame:
    """Join each row's index to a given embedding table (equi join, no size assumption)."""
    return indexed.join(table.select(F.col(id_col).alias(index_col), F.col(vec_col).alias("embedding")), index_col, "left")


def encode_time(df: DataFrame, t_col: str, max_time: Column | float, dim: int = 16) -> DataFrame:
    """Sinusoidal encoding of index = floor(t / max_time * dim) mod dim."""
    return df.withColumn("time_encoding", time_encoding(F.col(t_col), max_time, dim))


def edge_features(edges: DataFrame, type_col: str = "type") -> DataFrame:
    """X11: (amount, hash(operation type) mod 1000 / 1000) with a stable hash."""
    from ..functions.scalar import op_type_feature
    return edges.withColumn("type_feature", op_type_feature(F.col(type_col)))


def augment(edges: DataFrame, t_col: str, key_col: str, noise_std: float = 0.01, dropout: float = 0.1,
            scale_range: tuple = (0.8, 1.2), seed: int = 0) -> DataFrame:
    """Time noise (clamped to [0, 1]), age-weighted edge dropout (older edges dropped
    more) and one global time scaling factor drawn from the seed, clamped to [0, 1]."""
    k = F.col(key_col)
    x = edges.withColumn("t_noisy", time_noise(F.col(t_col), noise_std, seed, k))
    x = x.where(age_weighted_keep(F.col(t_col), k, dropout, seed))
    factor = scale_range[0] + (scale_range[1] - scale_range[0]) * \
        edges.sparkSession.range(1).select(uniform(F.lit(seed), seed, 9)).first()[0]
    return x.withColumn("t_scaled", F.least(F.greatest(F.col(t_col) * factor, F.lit(0.0)), F.lit(1.0)))
