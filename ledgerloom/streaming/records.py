"""Continuous ingest of all record types (M1, M2, M7): ledgers, transactions, operations and
effects from one landing folder into one table with a partition per batch and kind.

A landed line is an envelope ``{"stream": "transactions", "data": {...}}``.  One query decodes
it, keeps the newest record of each (kind, key) of the batch, parses every kind to its own typed
column, and writes the batch with one dynamic partition overwrite: a replayed batch replaces
itself.  A row of the commit table is written after it, with what the batch observed; readers
take only committed batches, so the kinds of a batch appear together or not at all.

Lines that are no envelope, name no known stream or have no key are kept as ``quarantine``.
"""
from __future__ import annotations

import json
import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators import ingest as ig
from .jobs import landing_stream

#: per kind: the key of a record, its event time, and the parser of its raw text
KINDS = {
    "ledgers": ("sequence", "closed_at", ig.parse_ledgers),
    "transactions": ("hash", "created_at", ig.parse_transactions),
    "operations": ("id", "created_at", lambda d: _operations(d)),
    "effects": ("id", "created_at", ig.parse_effects),
}


def _operations(raw: DataFrame) -> DataFrame:
    """A6 columns (the order inside a transaction is known only when all of it has come), with the
    raw text for the normalised hops."""
    parsed = ig.parse_operations(raw.withColumn("seq", F.lit(0)), seq_col="seq", keep=("raw",)).drop("application_order")
    return parsed.where(F.col("id").isNotNull())


#: fields of a record that ``decode`` looks at
_FIELDS = sorted({f for key, at, _ in KINDS.values() for f in (key, at)} | {"paging_token"})


def decode(lines: DataFrame) -> DataFrame:
    """kind, key, raw (the record's text), event time text, paging token of each landed line; kind is
    ``quarantine`` and raw the line where it cannot be routed."""
    # each text is parsed once: a generator keeps the parser's row, where fields taken one by one parse again
    envelope = F.from_json("value", "stream string, data string")
    rest = [c for c in lines.columns if c != "value"]
    d = lines.select("value", F.explode(F.array(envelope)).alias("e"), *rest)
    d = d.select("value", F.col("e.stream").alias("kind"), F.col("e.data").alias("raw"), *rest)
    fields = [f"f_{f}" for f in _FIELDS]
    d = d.select("*", F.json_tuple("raw", *_FIELDS).alias(*fields))
    pick = lambda at: F.coalesce(*[F.when(F.col("kind") == k, F.col(f"f_{v[at]}")) for k, v in KINDS.items()])
    d = d.select("value", "kind", "raw", *rest, pick(0).alias("key"), pick(1).alias("event_time"),
                 F.col("f_paging_token").alias("cursor"))
    known = F.col("kind").isin(*KINDS) & F.col("key").isNotNull()
    return d.select(F.when(known, F.col("kind")).otherwise("quarantine").alias("kind"), "key",
                    F.when(known, F.col("raw")).otherwise(F.col("value")).alias("raw"), "event_time", "cursor", *rest)


def overwrite_partitions(df: DataFrame, table: str, *by: str) -> None:
    """Replaces the partitions that ``df`` has rows of (Spark's dynamic overwrite).  A task has rows of few
    partitions: they are written side by side, without the sort by partition that Spark does otherwise."""
    conf, writers = df.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    old = conf.get(writers, "0")
    conf.set(writers, str(len(KINDS) + 1))
    try:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(table)
    finally:
        conf.set(writers, old)


def _typed(newest: DataFrame) -> DataFrame:
    """kind, key and one struct column per kind, null for the others."""
    parts = []
    for kind, (key, _, parse) in KINDS.items():
        p = parse(newest.where(F.col("kind") == kind).select("raw"))
        parts.append(p.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"),
                              F.struct(*p.columns).alias(kind)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _cursor_order(cursor: Column) -> Column:
    """Paging tokens are numbers, as far as they are numbers."""
    return F.struct(cursor.try_cast("decimal(38,0)").alias("n"), cursor.alias("text"))


def observations() -> list[Column]:
    at = F.to_timestamp(F.regexp_replace("event_time", "Z$", "+00:00"))
    return [F.count(F.lit(1)).alias("records"), F.count(F.when(F.col("kind") == "quarantine", 1)).alias("quarantined"),
            F.max(F.when(F.col("cursor").isNotNull(), _cursor_order(F.col("cursor"))))["text"].alias("cursor"),
            F.unix_timestamp(F.min(at)).alias("first_event"), F.unix_timestamp(F.max(at)).alias("last_event")]


def ingest_records(spark: SparkSession, landing: str, table: str, checkpoint: str, max_files: int | None = None,
                   available_now: bool = True, before_commit=None):
    """Starts the ingest; returns the query.  ``before_commit(batch_id)`` is called between the
    records and the commit row of a batch (tests let it fail there)."""
    lines = landing_stream(spark, landing, max_files).select("value", F.col("_metadata.file_modification_time").alias("landed"))

    def write(batch: DataFrame, batch_id: int) -> None:
        # as many partitions as the batch has splits of its files; records are dealt once and kept for all kinds
        parts = max(spark.sparkContext.defaultParallelism, 2 * batch.rdd.getNumPartitions())
        batch = batch.persist()
        newest = batch.where("kind <> 'quarantine'").select("kind", "key", "landed", "raw").repartition(parts, "kind", "key") \
            .groupBy("kind", "key").agg(F.max(F.struct("landed", "raw"))["raw"].alias("raw")).persist()
        try:
            bad = batch.where("kind = 'quarantine'").select("kind", F.col("raw").alias("quarantine"))
            rows = _typed(newest).unionByName(bad, allowMissingColumns=True)
            overwrite_partitions(rows.withColumn("batch_id", F.lit(batch_id)), table, "batch_id", "kind")
            if before_commit is not None:
                before_commit(batch_id)
            seen = batch.agg(*observations())
            overwrite_partitions(seen.withColumn("batch_id", F.lit(batch_id)), f"{table}_commits", "batch_id")
        finally:
            newest.unpersist()
            batch.unpersist()

    w = decode(lines).observe("ingest", *observations()).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()


def committed(spark: SparkSession, table: str) -> DataFrame:
    """Rows of the committed batches (the commit table has a few numbers per batch)."""
    done = spark.read.parquet(f"{table}_commits").select("batch_id")
    return spark.read.parquet(table).join(done, "batch_id", "left_semi")


def current(spark: SparkSession, table: str, kind: str, *fields: str) -> DataFrame:
    """The typed rows of one kind (or some fields of them): per key that of its last batch."""
    rows = committed(spark, table).where(F.col("kind") == kind)
    record = F.struct(*[F.col(kind)[f].alias(f) for f in fields]) if fields else F.col(kind)
    rows = rows.select("key", "batch_id", record.alias("r"))
    # few keys are in two batches: dealt as they are, in partitions that follow the files of the kind, and sorted once
    parts = max(spark.sparkContext.defaultParallelism, 8 * spark.read.parquet(table).where(F.col("kind") == kind).rdd.getNumPartitions())
    return rows.repartition(parts, "key").groupBy("key").agg(F.max_by("r", "batch_id").alias("r")).select("r.*")


def current_ledgers(spark: SparkSession, table: str) -> DataFrame:
    """Ledgers with stubs (A13) for those that only transactions name."""
    stubs = ig.ledger_stubs(current(spark, table, "transactions", "ledger_sequence", "created_at"),
                            current(spark, table, "ledgers", "sequence"))
    return current(spark, table, "ledgers").unionByName(stubs, allowMissingColumns=True)


def current_transfers(spark: SparkSession, table: str) -> DataFrame:
    """Normalised operations, path payments as hops (A10)."""
    return ig.normalize_with_hops(current(spark, table, "operations", "raw"))


def ingest_statistics(spark: SparkSession, table: str) -> DataFrame:
    """M7 over all committed batches and runs: records, quarantined lines, batches, records per second
    of event time, and the last cursor."""
    seconds = F.max("last_event") - F.min("first_event")
    return spark.read.parquet(f"{table}_commits").agg(
        F.coalesce(F.sum("records"), F.lit(0)).alias("processed"),
        F.coalesce(F.sum("quarantined"), F.lit(0)).alias("quarantined"), F.count(F.lit(1)).alias("batches"),
        F.when(seconds > 0, F.sum("records") / seconds).alias("records_per_sec"),
        F.max(F.when(F.col("cursor").isNotNull(), _cursor_order(F.col("cursor"))))["text"].alias("last_cursor"))


class IngestProgress(StreamingQueryListener):
    """Keeps what the ``ingest`` observations of a running query report (M7): records, wall-clock rate
    of the last batch and last cursor, per query id."""

    def __init__(self):
        self._lock = threading.Lock()
        self.stats: dict[str, dict] = {}

    def onQueryStarted(self, event) -> None:
        with self._lock:
            self.stats.setdefault(str(event.id), {"processed": 0, "batches": 0, "cursor": None, "records_per_sec": 0.0})

    def onQueryProgress(self, event) -> None:
        progress = json.loads(event.progress.json)
        seen = progress.get("observedMetrics", {}).get("ingest")
        if not seen or not seen.get("records"):
            return
        with self._lock:
            s = self.stats.setdefault(progress["id"], {"processed": 0, "batches": 0, "cursor": None, "records_per_sec": 0.0})
            s["processed"] += seen["records"]
            s["batches"] += 1
            s["records_per_sec"] = progress.get("processedRowsPerSecond", 0.0)
            number = lambda c: (int(c) if str(c).isdigit() else -1, str(c))
            if seen.get("cursor") is not None and (s["cursor"] is None or number(seen["cursor"]) > number(s["cursor"])):
                s["cursor"] = seen["cursor"]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
