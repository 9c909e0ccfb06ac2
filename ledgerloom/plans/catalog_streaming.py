"""Registered queries: file sources/sinks and streaming jobs.

Each query lands data Spark derives from the driver tables into a fresh folder under the
session's checkpoint directory, runs the job to completion (``availableNow``) and returns the
resulting table, so the driver can compare it with the batch oracle."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest as ig
from ..operators import quality as qa
from ..sources import files as fl
from ..sources.adapters import acct_edges, raw_ops, reports, txn, validators, with_views
from ..streaming import alerts as sa
from ..streaming import jobs as sj
from ..streaming import records as sr
from .catalog_extra import _TX_SQL, _tx_json
from .catalog_ingest import _EFFECTS_SQL, _HOPS_SQL, _LEDGERS_SQL, _NORM_SQL, _effect_json, _ledger_json
from .catalog_quality import _FIELDS, _HASH_SQL
from .registry import register


def land_in_time_order(df, order_col: str, run, fmt: str = "text", chunks: int = 4) -> None:
    """Lands ``df`` in ``chunks`` ascending ranges of ``order_col`` and calls ``run(landing)`` after
    each: the stream resumes from its checkpoint and takes the new files as one micro-batch.

    The rows are written once, partitioned by chunk (as many files as the scan has tasks), and
    a chunk lands by moving its folder."""
    spark = df.sparkSession
    b = df.agg(F.min(order_col).alias("a"), F.max(order_col).alias("b")).first()
    lo, hi = b["a"] or 0, b["b"] or 0
    width = max((hi - lo) / chunks, 1)
    stage, landing = fl.shared_dir(spark, "stage"), fl.shared_dir(spark, "landing")
    chunk = F.least(F.floor((F.col(order_col) - lo) / width), F.lit(chunks - 1)).cast("int")
    w = df.withColumn("_chunk", chunk).drop(order_col).write.partitionBy("_chunk")
    (w.text(stage) if fmt == "text" else w.json(stage))
    fs, at = sj._path(spark, landing)
    fs.mkdirs(at)
    for i in range(chunks):
        part = sj._path(spark, f"{stage}/_chunk={i}")[1]
        if fs.exists(part):
            for f in fs.listStatus(part):
                fs.rename(f.getPath(), sj._path(spark, f"{landing}/{i}-{f.getPath().getName()}")[1])
            run(landing)


def _ingest(spark, sf_dir):
    r = raw_ops(spark, sf_dir).select("seq", F.col("raw").alias("value"))
    table, quarantine, ck = (fl.shared_dir(spark, n) for n in ("ops-table", "quarantine", "ck-ingest"))
    with sj.state_partitions(spark):
        land_in_time_order(r, "seq", lambda landing: sj.ingest_operations(
            spark, landing, table, quarantine, ck).awaitTermination())
    return table


@register("stream_ingest", operators="M1 M2 A12 A10 (landing -> normalised ops, keyed upsert per micro-batch)",
          sql=with_views(_NORM_SQL + " WHERE type <> 'path_payment_strict_send' UNION ALL " + _HOPS_SQL, "ops_x"),
          doubles=["amount"])
def q_stream_ingest(spark, sf_dir):
    t = spark.read.parquet(_ingest(spark, sf_dir))
    w = t.groupBy("transaction_hash", "operation_id").agg(F.max("batch_id").alias("batch_id"))
    return t.join(w, ["transaction_hash", "operation_id", "batch_id"], "left_semi").select(
        "transaction_hash", "sender", "receiver", "asset", "amount", F.unix_timestamp("timestamp").alias("ts"))


@register("stream_statistics", operators="M7 (processed records of the ingest stream)",
          sql="SELECT CAST(COUNT(*) AS BIGINT) AS processed FROM events")
def q_stream_stats(spark, sf_dir):
    return sj.stream_statistics(spark, _ingest(spark, sf_dir)).select("processed")


def _envelopes(spark, sf_dir):
    """(value, at): lines of all four streams by the event that brings them (a ledger comes after its ten
    events, a transaction after its two); every seventh operation comes a second time, 500 events later;
    a few lines cannot be routed."""
    number = lambda f: F.get_json_object("raw", f"$.{f}").cast("long")
    parts = [("ledgers", _ledger_json(spark, sf_dir), number("sequence") * 10),
             ("transactions", _tx_json(spark, sf_dir), F.substring(F.get_json_object("raw", "$.memo"), 2, 20).cast("long") * 2 + 1),
             ("operations", raw_ops(spark, sf_dir), number("id")), ("effects", _effect_json(spark, sf_dir), number("id"))]
    line = lambda stream, at: F.struct(
        F.concat(F.lit(f'{{"stream":"{stream}","data":'), "raw", F.lit("}")).alias("value"), at.alias("at"))
    at, again = F.col("at"), {"operations": lambda: F.when(F.col("seq") % 7 == 0, line("operations", at + 500)),
                              "effects": lambda: F.when(at % 1000 == 0, line("offers", at))}
    out = None
    for name, raw, when in parts:
        # a record's text is made once for all lines that it comes in
        x = raw.withColumn("at", when)
        if name in again:
            x = x.select(F.explode(F.filter(F.array(line(name, at), again[name]()), lambda e: e.isNotNull())).alias("e")).select("e.*")
        else:
            x = x.select(line(name, at).alias("e")).select("e.*")
        out = x if out is None else out.unionByName(x)
    return out


def land_in_steps(df, order_col: str, run, steps: int = 3) -> None:
    """Appends ``df`` to a landing folder in ascending ranges of ``order_col`` and calls ``run(landing)``
    after each; the rows are computed once."""
    spark = df.sparkSession
    landing = fl.shared_dir(spark, "landing")
    df = fl.stored(df)
    b = df.agg(F.min(order_col).alias("a"), F.max(order_col).alias("b")).first()
    width = max(((b["b"] or 0) - (b["a"] or 0) + 1) / steps, 1)
    step = F.floor((F.col(order_col) - (b["a"] or 0)) / width)
    for i in range(steps):
        df.where(step == i).drop(order_col).write.mode("append").text(landing)
        run(landing)


def _ingest_records(spark, sf_dir):
    table, ck = fl.shared_dir(spark, "records"), fl.shared_dir(spark, "ck-records")
    with sj.state_partitions(spark):
        land_in_steps(_envelopes(spark, sf_dir), "at",
                      lambda landing: sr.ingest_records(spark, landing, table, ck).awaitTermination())
    return table


@register("stream_ledgers", operators="M1 A4 A13 (ledgers of the four-kind stream)", sql=_LEDGERS_SQL,
          doubles=["total_coins", "fee_pool"])
def q_stream_ledgers(spark, sf_dir):
    p = sr.current_ledgers(spark, _ingest_records(spark, sf_dir))
    return p.select("sequence", "successful_transaction_count", "failed_transaction_count", "operation_count", "total_coins",
                    "fee_pool", "base_fee_in_stroops", "protocol_version", F.unix_timestamp("closed_at").alias("closed_ts"))


@register("stream_transactions", operators="M1 A5 (transactions of the four-kind stream)",
          sql=with_views("SELECT * FROM txp", extra=[_TX_SQL]))
def q_stream_transactions(spark, sf_dir):
    t = sr.current(spark, _ingest_records(spark, sf_dir), "transactions")
    return t.select("hash", "ledger_sequence", "source_account", F.col("fee").cast("long").alias("fee"),
                    F.col("operation_count").cast("long").alias("operation_count"), "successful",
                    F.unix_timestamp("created_at").alias("created_ts"))


@register("stream_transfers", operators="M1 A10 (operations of the four-kind stream, normalised with hops)",
          sql=with_views(_NORM_SQL + " WHERE type <> 'path_payment_strict_send' UNION ALL " + _HOPS_SQL, "ops_x"),
          doubles=["amount"])
def q_stream_transfers(spark, sf_dir):
    t = sr.current_transfers(spark, _ingest_records(spark, sf_dir))
    return t.select("transaction_hash", "sender", "receiver", "asset", "amount", F.unix_timestamp("timestamp").alias("ts"))


@register("stream_effects", operators="M1 A7 (effects of the four-kind stream)", sql=_EFFECTS_SQL, doubles=["amount"])
def q_stream_effects(spark, sf_dir):
    return sr.current(spark, _ingest_records(spark, sf_dir), "effects").drop("created_at")


@register("stream_cursor", operators="M7 (records, quarantine, event-time rate and last cursor of all batches)",
          sql="""WITH t AS (SELECT event_id, epoch_us(ts) // 1000000 AS s FROM events),
n AS (SELECT 2 * COUNT(*) + COUNT(*) FILTER (WHERE event_id % 7 = 0) + COUNT(*) FILTER (WHERE event_id % 1000 = 0)
  + COUNT(DISTINCT event_id // 10) + COUNT(DISTINCT event_id // 2) AS n FROM t)
SELECT CAST(n AS BIGINT) AS processed, (SELECT COUNT(*) FROM t WHERE event_id % 1000 = 0) AS quarantined,
  n / (SELECT MAX(s) - MIN(s) FROM t) AS records_per_sec, (SELECT CAST(MAX(event_id) AS VARCHAR) FROM t) AS last_cursor FROM n""",
          doubles=["records_per_sec"])
def q_stream_cursor(spark, sf_dir):
    return sr.ingest_statistics(spark, _ingest_records(spark, sf_dir)).drop("batches")


_ALERT_SQL = """m AS (SELECT (CAST("timestamp" AS BIGINT) // 60) * 60 AS m, CAST("timestamp" AS BIGINT) AS ts,
    id IS NULL OR source_account IS NULL OR TRY_CAST(amount AS DOUBLE) IS NULL AS bad FROM txn2),
wm AS (SELECT MAX(m) - 60 AS w FROM m),
gaps AS (SELECT ts, LEAD(ts) OVER (ORDER BY ts) AS nx FROM (SELECT DISTINCT ts FROM m) d)"""
#: errors per second; the views' errors are rarer than those of the alert rule
_ALERT_LIMIT = 0.001


def _alerts(spark, sf_dir):
    out, ck = fl.shared_dir(spark, "alerts-out"), fl.shared_dir(spark, "ck-alerts")
    t = qa.validate(txn(spark, sf_dir), ["id", "source_account"], {"amount": "double"}).select(
        F.lit("txn").alias("stream_type"), F.col("timestamp").cast("long").alias("ts"), (~F.col("is_valid")).alias("is_error"))
    lines = t.select(F.to_json(F.struct("stream_type", "ts", "is_error")).alias("value"), "ts")

    def run(landing):
        s = spark.readStream.schema("stream_type string, ts long, is_error boolean").json(landing)
        sa.alert_stream(s, limit=_ALERT_LIMIT).writeStream.format("parquet").option("path", out) \
            .option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()

    with sj.state_partitions(spark), sa.rocksdb_state(spark):
        land_in_steps(lines, "ts", run)
    return spark.read.parquet(out)


@register("stream_stall_alerts", operators="M5 (stalls by event-time timers in a stateful stream)",
          sql=with_views("SELECT ts AS last_record, ts + 1500 AS at FROM gaps, wm WHERE nx - ts > 1500 AND ts + 1500 <= w",
                         "txn", extra=[_ALERT_SQL]))
def q_stream_stalls(spark, sf_dir):
    return _alerts(spark, sf_dir).where("alert = 'stalled'").select("last_record", "at")


@register("stream_error_alerts", operators="M5 (error rate over 5 minutes held for 2 minutes, by timers)",
          sql=with_views(f"""SELECT e.at FROM ev e WHERE (SELECT COUNT(*) FROM ev p WHERE p.at IN (e.at - 60, e.at - 120)) = 2""",
                         "txn", extra=[_ALERT_SQL, f"""pt AS (SELECT DISTINCT m + 60 * k AS at FROM m, range(1, 6) r(k) WHERE bad),
ev AS (SELECT pt.at FROM pt, wm JOIN m ON m.m >= pt.at - 300 AND m.m < pt.at AND m.bad WHERE pt.at <= w
  GROUP BY pt.at HAVING COUNT(*) > {_ALERT_LIMIT} * 300)"""]))
def q_stream_errors(spark, sf_dir):
    return _alerts(spark, sf_dir).where("alert = 'error_rate'").select("at")


_TXN_SCHEMA = "seq long, id string, source_account string, amount string, payload string, timestamp string"


@register("stream_dedupe", operators="M3 Q2 (dropDuplicatesWithinWatermark on the record hash)",
          sql=with_views(f"SELECT DISTINCT {_HASH_SQL} AS hash FROM txn2", "txn"))
def q_stream_dedupe(spark, sf_dir):
    out, ck = fl.shared_dir(spark, "dedupe-out"), fl.shared_dir(spark, "ck-dedupe")

    def run(landing):
        s = spark.readStream.schema(_TXN_SCHEMA).json(landing)
        s = qa.with_hash(s, _FIELDS).withColumn("event_time", F.timestamp_seconds(F.col("timestamp").cast("long")))
        d = sj.dedupe_stream(s, "hash", "event_time", "1 day")
        d.select("hash", "seq").writeStream.format("parquet").option("path", out).option("checkpointLocation", ck) \
            .trigger(availableNow=True).start().awaitTermination()

    t = txn(spark, sf_dir)
    with sj.state_partitions(spark):
        land_in_time_order(t.withColumn("_o", F.col("timestamp").cast("long")), "_o", run, fmt="json")
    return spark.read.parquet(out).select("hash")


def _upserted(spark, counts, name, keys, df, order, schema):
    """Streams ``df`` through ``counts(stream)`` (update mode) into an upserted table."""
    out, ck = fl.shared_dir(spark, f"{name}-out"), fl.shared_dir(spark, f"ck-{name}")

    def run(landing):
        counts(spark.readStream.schema(schema).json(landing)).writeStream.outputMode("update") \
            .foreachBatch(sj.upsert_sink(out, keys)).option("checkpointLocation", ck) \
            .trigger(availableNow=True).start().awaitTermination()

    with sj.state_partitions(spark):
        land_in_time_order(df.withColumn("_o", order), "_o", run, fmt="json")
    return sj.latest(spark, out, keys)


@register("stream_error_rates", operators="M5 (per 5-minute window: records, validation errors, rates, alert)",
          sql=with_views("""SELECT CAST(w AS BIGINT) AS window_start, CAST(COUNT(*) AS BIGINT) AS records,
  CAST(SUM(CASE WHEN id IS NULL OR source_account IS NULL OR TRY_CAST(amount AS DOUBLE) IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS errors,
  COUNT(*) / 300.0 AS records_per_sec,
  SUM(CASE WHEN id IS NULL OR source_account IS NULL OR TRY_CAST(amount AS DOUBLE) IS NULL THEN 1 ELSE 0 END) / 300.0 AS errors_per_sec,
  SUM(CASE WHEN id IS NULL OR source_account IS NULL OR TRY_CAST(amount AS DOUBLE) IS NULL THEN 1 ELSE 0 END) / 300.0 > 0.1 AS error_alert
FROM (SELECT *, (CAST("timestamp" AS BIGINT) // 300) * 300 AS w FROM txn2) t GROUP BY w""", "txn"),
          doubles=["records_per_sec", "errors_per_sec"])
def q_stream_rates(spark, sf_dir):
    def counts(s):
        s = qa.validate(s, ["id", "source_account"], {"amount": "double"}) \
            .withColumn("event_time", F.timestamp_seconds(F.col("timestamp").cast("long")))
        return (s.withWatermark("event_time", "1 day").groupBy(F.window("event_time", "300 seconds").alias("window"))
                .agg(F.count(F.lit(1)).alias("records"), F.sum((~F.col("is_valid")).cast("long")).alias("errors"))
                .select(F.unix_timestamp(F.col("window.start")).alias("window_start"), "records", "errors"))

    t = txn(spark, sf_dir)
    return sj.rate_alerts(_upserted(spark, counts, "rates", ["window_start"], t, F.col("timestamp").cast("long"), _TXN_SCHEMA), 300)


@register("stall_windows", operators="M5 stall (rate over 10 minutes zero, held 15 minutes)",
          sql=with_views("""SELECT ts AS last_record, ts + 1500 AS stalled_from, nx AS next_record FROM (
  SELECT CAST("timestamp" AS BIGINT) AS ts, LEAD(CAST("timestamp" AS BIGINT)) OVER (ORDER BY CAST("timestamp" AS BIGINT), seq) AS nx FROM txn2) t
WHERE nx - ts > 1500""", "txn"))
def q_stalls(spark, sf_dir):
    t = txn(spark, sf_dir).select("seq", F.col("timestamp").cast("long").alias("ts"), F.lit("txn").alias("stream_type"))
    return sj.stalls(t, "ts", "seq", "stream_type").drop("stream_type")


@register("stream_window_counts", operators="M4 (7-day windows sliding 1 day, half-open, watermark, upsert sink)",
          sql=with_views("""SELECT CAST(ws AS BIGINT) AS window_start, CAST(ws + 604800 AS BIGINT) AS window_end,
  CAST(COUNT(*) AS BIGINT) AS edge_count, CAST(SUM(CAST(COALESCE(amount, 0.0) AS DECIMAL(38,7))) AS DOUBLE) AS volume
FROM (SELECT e.*, ((ts // 86400) - k) * 86400 AS ws FROM acct_edges e, range(0, 7) r(k)) x GROUP BY ws""", "acct_edges"),
          doubles=["volume"])
def q_stream_windows(spark, sf_dir):
    def counts(s):
        return (s.withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", "8 days")
                .groupBy(F.window("event_time", "7 days", "1 day").alias("window"))
                .agg(F.count(F.lit(1)).alias("edge_count"),
                     F.sum(F.coalesce("amount", F.lit(0.0)).cast("decimal(38,7)")).cast("double").alias("volume"))
                .select(F.unix_timestamp("window.start").alias("window_start"),
                        F.unix_timestamp("window.end").alias("window_end"), "edge_count", "volume"))

    e = acct_edges(spark, sf_dir).select("src", "dst", "amount", "ts")
    return _upserted(spark, counts, "windows", ["window_start"], e, F.col("ts"), "src string, dst string, amount double, ts long")


@register("stream_consensus", operators="M6 G13 (stateful distinct validators per account, update mode)",
          sql=with_views("""SELECT r.account_id, CAST(COUNT(DISTINCT r.validator) AS BIGINT) AS n_validators,
  COUNT(DISTINCT r.validator) >= 3 AS fraudulent
FROM reports r JOIN validators v ON r.validator = v.validator
WHERE v.is_active AND v.reputation >= 50 AND r.confidence >= 60 GROUP BY r.account_id""", "reports"))
def q_stream_consensus(spark, sf_dir):
    rp = reports(spark, sf_dir)
    c = _upserted(spark, lambda s: sj.consensus_stream(s, validators(spark)), "consensus", ["account_id"], rp, F.col("ts"),
                  "account_id long, validator string, confidence int, seq long, ts long")
    return c.withColumn("n_validators", F.col("n_validators").cast("long"))


_BACKFILL_SQL = """SELECT ledger_sequence, operation_id, transaction_hash, type, sender,
  CASE WHEN type = 'change_trust' THEN NULL ELSE cp END AS receiver,
  CASE WHEN type IN ('payment', 'path_payment_strict_send', 'change_trust') THEN ev_asset ELSE 'UNKNOWN' END AS asset,
  CASE type WHEN 'payment' THEN value WHEN 'create_account' THEN value
            WHEN 'path_payment_strict_send' THEN half ELSE NULL END AS amount, ts
FROM ops_x"""


def _backfill_roundtrip(spark, sf_dir, fmt):
    flat = ig.parse_json(raw_ops(spark, sf_dir), ig.OPERATION_SCHEMA, keep=("seq",)).select("seq", "r.*")
    folder = fl.shared_dir(spark, f"backfill-{fmt}")
    if fmt == "parquet":
        fl.write_parquet_zstd(flat, folder)
    else:
        flat.write.mode("overwrite").json(folder)
        # rename-free: the JSON writer names files *.json; a jsonl copy is what backfills ship
        spark.read.text(folder).write.mode("overwrite").text(folder + "-lines")
        jvm = spark.sparkContext._jvm
        fs, p = fl._fs(spark, folder + "-lines")
        for st in fs.listStatus(p):
            name = st.getPath().getName()
            if name.startswith("part-"):
                fs.rename(st.getPath(), jvm.org.apache.hadoop.fs.Path(p, name.split(".")[0] + ".jsonl"))
        folder = folder + "-lines"
    rows = fl.scan_backfill(spark, folder)
    out = ig.normalize_backfill(rows, order_col="seq")
    return out.withColumn("ts", F.unix_timestamp("timestamp")).drop("timestamp")


@register("backfill_parquet_roundtrip", operators="A2 A1 A3 (zstd parquet sink, format-detecting scan, normalise)",
          sql=with_views(_BACKFILL_SQL, "ops_x"), doubles=["amount"])
def q_backfill_parquet(spark, sf_dir):
    return _backfill_roundtrip(spark, sf_dir, "parquet")


@register("backfill_jsonl_roundtrip", operators="A1 A3 (JSON-lines backfill directory)",
          sql=with_views(_BACKFILL_SQL, "ops_x"), doubles=["amount"])
def q_backfill_jsonl(spark, sf_dir):
    return _backfill_roundtrip(spark, sf_dir, "jsonl")


@register("ledger_json_array_roundtrip", operators="A14 (one JSON array over the files of all tasks, read back)",
          sql="""SELECT CAST(event_id // 10 + 1 AS BIGINT) AS sequence, CAST(COUNT(*) AS BIGINT) AS operation_count,
  MAX(value) AS total_coins, 'array' AS form FROM events GROUP BY 1""", doubles=["total_coins"])
def q_ledger_json_array(spark, sf_dir):
    folder = fl.shared_dir(spark, "ledgers-json-array")
    ledgers = _ledger_json(spark, sf_dir).select(F.from_json("raw", ig.LEDGER_SCHEMA).alias("r")).select("r.*")
    fl.write_ledger_json(ledgers, folder, "array")
    back = fl.read_ledger_json(spark, folder, ig.LEDGER_SCHEMA)
    raw = back.select(F.to_json(F.struct(*[F.col(c) for c in ig.LEDGER_SCHEMA.fieldNames()])).alias("raw"))
    return ig.parse_ledgers(raw).select("sequence", "operation_count", "total_coins",
                                        F.lit(fl.json_form(spark, folder)).alias("form"))


@register("ledger_json_roundtrip", operators="A14 A4 (write JSON lines, read back, parse ledgers)",
          sql="""SELECT CAST(event_id // 10 + 1 AS BIGINT) AS sequence, CAST(COUNT(*) AS BIGINT) AS operation_count,
  MAX(value) AS total_coins FROM events GROUP BY 1""", doubles=["total_coins"])
def q_ledger_json(spark, sf_dir):
    folder = fl.shared_dir(spark, "ledgers-json")
    fl.write_ledger_json(_ledger_json(spark, sf_dir).select(F.from_json("raw", ig.LEDGER_SCHEMA).alias("r")).select("r.*"),
                         folder)
    back = fl.read_ledger_json(spark, folder, ig.LEDGER_SCHEMA)
    raw = back.select(F.to_json(F.struct(*[F.col(c) for c in ig.LEDGER_SCHEMA.fieldNames()])).alias("raw"))
    return ig.parse_ledgers(raw).select("sequence", "operation_count", "total_coins")
