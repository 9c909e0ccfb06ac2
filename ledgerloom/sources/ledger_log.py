"""Incremental, idempotent ingest of ledger ranges with their payload.

A table has a commit log beside it: one row per ledger that has been ingested and the commit that
did it.  A run takes the ledgers of its range that the log lacks (left anti join), joins their
payload, writes it as a partition of a new commit, and then the log rows of that commit.  Readers
take what the log names.  A run that breaks off in between leaves rows that nobody sees; the next
run ingests these ledgers again, and each is read once.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import resolve_range
from ..session import cut_lineage
from .files import _fs

LOG = "ledger long, commit string"


def commit_log(spark: SparkSession, table: str) -> DataFrame:
    """(ledger, commit) of all ingested ledgers."""
    path = f"{table}_log"
    fs, p = _fs(spark, path)
    return spark.read.schema(LOG).parquet(path) if fs.exists(p) else spark.createDataFrame([], LOG)


def ingested(spark: SparkSession, table: str) -> DataFrame:
    """Payload rows of the committed ledgers."""
    return spark.read.parquet(table).join(commit_log(spark, table), ["ledger", "commit"], "left_semi")


def ingest_ledgers(payload: DataFrame, table: str, start: int | None = None, end: int | None = None,
                   ledgers_per_commit: int = 100_000, before_commit=None) -> DataFrame:
    """Ingests payload(ledger, ...) for the range (bounds as :func:`resolve_range`; the last processed
    ledger comes from the log) and returns (ledger, status): ``processed`` by this run, ``skipped`` as
    processed before, ``missing`` without a payload (not logged, so a later run tries them again).

    Ranges longer than ``ledgers_per_commit`` are committed piece by piece, so a run that breaks off
    loses at most one piece.  ``before_commit(number of the piece)`` runs between payload and log."""
    spark = payload.sparkSession
    before = commit_log(spark, table)
    bounds = resolve_range(start, end, before.agg(F.max("ledger")).first()[0])
    if bounds is None:
        return spark.createDataFrame([], "ledger long, status string")
    # as it stands now: the log grows below
    done = cut_lineage(before.select("ledger").where(F.col("ledger").between(*bounds)).distinct())
    for number, low in enumerate(range(bounds[0], bounds[1] + 1, ledgers_per_commit), 1):
        high = min(bounds[1], low + ledgers_per_commit - 1)
        commit = uuid.uuid4().hex
        new = payload.where(F.col("ledger").between(low, high)).join(done, "ledger", "left_anti")
        new.withColumn("commit", F.lit(commit)).write.mode("append").partitionBy("commit").parquet(table)
        if before_commit is not None:
            before_commit(number)
        written = spark.read.schema(LOG).parquet(table).where(F.col("commit") == commit)
        written.select("ledger", "commit").distinct().write.mode("append").parquet(f"{table}_log")
    now = commit_log(spark, table).where(F.col("ledger").between(*bounds)).select("ledger").distinct().withColumn("_in", F.lit(True))
    ledgers = spark.range(bounds[0], bounds[1] + 1).select(F.col("id").alias("ledger"))
    return ledgers.join(now, "ledger", "left").join(done.withColumn("_old", F.lit(True)), "ledger", "left").select(
        "ledger", F.when(F.col("_old"), "skipped").when(F.col("_in"), "processed").otherwise("missing").alias("status"))
