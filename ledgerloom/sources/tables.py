"""Reading the driver tables (one parquet file/dir per table)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy parquet scan; Catalyst prunes columns and pushes filters into it."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deals rows out for CPU-heavy row work (building / decoding JSON): to ``partitions``, by
    default the cluster's parallelism, where a table is stored as few unsplittable files."""
    return df.repartition(partitions or df.sparkSession.sparkContext.defaultParallelism)
