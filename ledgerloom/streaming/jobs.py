"""Structured Streaming: continuous ingest with idempotent keyed upserts (M1, M2, A12),
stream dedupe (M3), windowed snapshot counts (M4), ingest/error rates and stall alerts (M5),
running fraud consensus with state (M6) and stream statistics (M7).

Records arrive as JSON text files in a landing directory.  Each query has its own checkpoint
location (the resume cursor, M2).  Sinks add each micro-batch as one folder, published by a
rename, and readers take the last batch of a key: a replayed batch changes nothing, a crash
leaves no half-written table, and a batch costs its own size.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest as ig
from ..plans.ordering import windowed


class state_partitions:
    """Context manager: start stateful streaming queries with ``n`` state partitions.

    A stateful query fixes its number of state-store partitions from
    ``spark.sql.shuffle.partitions`` at its first start (the checkpoint keeps it).  Sizing it to
    the cluster's parallelism instead of an arbitrary session default avoids hundreds of tiny
    state tasks per micro-batch; the session setting is restored afterwards."""

    def __init__(self, spark: SparkSession, n: int | None = None):
        self.spark, self.n = spark, n or spark.sparkContext.defaultParallelism

    def __enter__(self):
        self.old = self.spark.conf.get("spark.sql.shuffle.partitions")
        self.spark.conf.set("spark.sql.shuffle.partitions", str(self.n))
        return self

    def __exit__(self, *exc):
        self.spark.conf.set("spark.sql.shuffle.partitions", self.old)
        return False


def landing_stream(spark: SparkSession, landing: str, max_files: int | None = None) -> DataFrame:
    """Text lines of the landing directory as a stream (``value`` column)."""
    r = spark.readStream.format("text")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(landing)


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def commit_batch(df: DataFrame, table: str, batch_id: int) -> None:
    """Adds one micro-batch to a table as the folder ``batch_id=<n>``.

    The rows are written beside it first and moved in by one rename, so readers see a batch as
    a whole or not at all; a batch that is there already (a replay) is left as it is."""
    spark = df.sparkSession
    fs, target = _path(spark, f"{table}/batch_id={batch_id}")
    if fs.exists(target):
        return
    stage = f"{table}/_stage/{uuid.uuid4().hex}"
    df.write.parquet(stage)
    if not fs.rename(_path(spark, stage)[1], target) and not fs.exists(target):
        raise OSError(f"cannot publish batch {batch_id} of {table}")


def latest(spark: SparkSession, table: str, keys: list[str]) -> DataFrame:
    """The table's current rows: per key the row of its last batch (a grouped maximum)."""
    t = spark.read.parquet(table)
    rest = [c for c in t.columns if c not in (*keys, "batch_id")]
    g = t.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_r"))
    return g.select(*keys, "_r.*")


def upsert_sink(table: str, keys: list[str], order_cols: list[str] = ()):
    """foreachBatch writer of an upserted table (read it with :func:`latest`).

    Inside a batch the row with the largest ``order_cols`` wins; without them the batch has one
    row per key already (update-mode aggregates)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        b = batch
        if order_cols:
            rest = [c for c in b.columns if c not in keys]
            b = b.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order_cols)).alias("_r")).select(*keys, "_r.*")
        commit_batch(b, table, batch_id)
    return write


def ingest_operations(spark: SparkSession, landing: str, table: str, quarantine: str, checkpoint: str,
                      max_files: int | None = None, available_now: bool = True):
    """M1/M2: landing JSON -> normalised operations (path payments as hops, A10) upserted by
    transaction hash and operation; undecodable lines go to the quarantine table.  Inside a
    batch the record of the newest file wins, then the larger text.  ``<table>_stats`` gets the
    number of records of each batch.  Returns the query."""
    raw = landing_stream(spark, landing, max_files).select(
        F.col("value").alias("raw"), F.col("_metadata.file_modification_time").alias("_landed"))
    parsed = raw.select("raw", "_landed", F.from_json("raw", ig.OPERATION_SCHEMA).alias("r"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()       # the stream's plan runs once for the outputs below
        try:
            ok = F.col("r").isNotNull() & F.col("r.transaction_hash").isNotNull()
            good = batch.where(ok).groupBy("r.transaction_hash", "r.id").agg(
                F.max_by("raw", F.struct("_landed", "raw")).alias("raw")).select("raw")
            commit_batch(ig.normalize_with_hops(good), table, batch_id)
            commit_batch(batch.where(~F.coalesce(ok, F.lit(False))).select("raw"), quarantine, batch_id)
            commit_batch(batch.agg(F.count(F.lit(1)).alias("records")), f"{table}_stats", batch_id)
        finally:
            batch.unpersist()

    w = parsed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def dedupe_stream(stream: DataFrame, key_col: str, ts_col: str, watermark: str = "1 day") -> DataFrame:
    """M3/Q2: drop records whose key was already seen within the watermark delay
    (``dropDuplicatesWithinWatermark``); state is bounded by the watermark."""
    return stream.withWatermark(ts_col, watermark).dropDuplicatesWithinWatermark([key_col])


def window_counts(stream: DataFrame, ts_col: str, size: str, slide: str | None = None,
                  watermark: str = "1 day", group_cols: list[str] = ()) -> DataFrame:
    """M4: edge and node-endpoint counts per sliding event-time window (half-open
    [start, end), unlike the batch W9 which is inclusive on both ends)."""
    w = F.window(ts_col, size, slide) if slide else F.window(ts_col, size)
    return (stream.withWatermark(ts_col, watermark)
            .groupBy(w.alias("window"), *group_cols)
            .agg(F.count(F.lit(1)).alias("edge_count"), F.sum(F.coalesce("amount", F.lit(0.0))).alias("volume")))


def rate_alerts(counts: DataFrame, window_seconds: int, error_rate_limit: float = 0.1) -> DataFrame:
    """M5 on windowed counts (records, errors per window and stream type): rates per second
    and an alert flag when errors exceed ``error_rate_limit`` per second."""
    return (counts.withColumn("records_per_sec", F.col("records") / F.lit(float(window_seconds)))
            .withColumn("errors_per_sec", F.col("errors") / F.lit(float(window_seconds)))
            .withColumn("error_alert", F.col("errors_per_sec") > F.lit(error_rate_limit)))


# Alert rules (seconds): no record for the range, held for the hold time.
STALL_RANGE, STALL_HOLD = 600, 900


def stalls(records: DataFrame, ts_col: str, tie_col: str, group_col: str, quiet: int = STALL_RANGE + STALL_HOLD) -> DataFrame:
    """M5 stall: (group, last_record, stalled_from, next_record) wherever two records in a row
    are more than ``quiet`` seconds apart: the rate over the range is then zero during the whole
    hold time.  Neighbouring records are found over chunks of a range-partitioned order, so a
    stream type is no single task."""
    r = windowed(records.select(group_col, ts_col, tie_col), [group_col], [F.col(ts_col), F.col(tie_col)], 0, 1,
                 lambda w: [F.lead(ts_col).over(w).alias("next_record")])
    return r.where(F.col("next_record") - F.col(ts_col) > quiet).select(
        group_col, F.col(ts_col).alias("last_record"), (F.col(ts_col) + quiet).alias("stalled_from"), "next_record")


CONSENSUS_STATE = "validators array<string>"
CONSENSUS_OUT = "account_id long, n_validators int, fraudulent boolean"


def consensus_stream(reports: DataFrame, validators: DataFrame, threshold: int = 3,
                     min_reputation: int = 50, min_confidence: int = 60) -> DataFrame:
    """M6: running fraud consensus per account.  Reports are checked against the validator
    table (stream-static join), then ``applyInPandasWithState`` keeps the distinct validators
    of each account (bounded by the validator registry) and emits the current count and the
    fraudulent flag (>= threshold) in update mode."""
    ok = (reports.join(validators, "validator")
          .where(F.col("is_active") & (F.col("reputation") >= min_reputation) & (F.col("confidence") >= min_confidence))
          .select("account_id", "validator"))

    def update(key, pdfs: Iterator[pd.DataFrame], state):
        seen = set(state.get[0]) if state.exists else set()
        for pdf in pdfs:
            seen.update(pdf["validator"].tolist())
        state.update((sorted(seen),))
        yield pd.DataFrame({"account_id": [key[0]], "n_validators": [len(seen)],
                            "fraudulent": [len(seen) >= threshold]})

    return ok.groupBy("account_id").applyInPandasWithState(
        update, CONSENSUS_OUT, CONSENSUS_STATE, "update", "NoTimeout")


def stream_statistics(spark: SparkSession, table: str) -> DataFrame:
    """M7: records and micro-batches that the ingest into ``table`` has processed so far, over
    all its runs (from what each batch wrote, not from the session's bounded progress list)."""
    return spark.read.parquet(f"{table}_stats").agg(
        F.coalesce(F.sum("records"), F.lit(0)).alias("processed"), F.count_distinct("batch_id").alias("batches"))
