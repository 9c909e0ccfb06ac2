"""Registered queries: ingest and normalisation.

Spark side: events -> raw JSON operations (``raw_ops``) -> the operator under test.
Oracle side: the expected normalised fields computed straight from ``events`` (``ops_x``).
"""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import parse_memo, record_hash
from ..operators import ingest as ig
from ..sources.adapters import (EVENT_ASSETS, epoch_seconds, raw_ops, with_views)
from ..sources import files as fl
from ..sources import ledger_log as ll
from ..sources.tables import read_table
from .registry import register

CUTOFF = "2024-01-15 00:00:00"
CUTOFF_S = 1705276800

_NORM_SQL = """SELECT transaction_hash, sender,
  CASE WHEN type = 'change_trust' THEN NULL ELSE cp END AS receiver,
  CASE WHEN type IN ('payment', 'path_payment_strict_send', 'change_trust') THEN ev_asset ELSE 'UNKNOWN' END AS asset,
  CASE type WHEN 'payment' THEN value WHEN 'create_account' THEN value
            WHEN 'path_payment_strict_send' THEN half ELSE NULL END AS amount,
  ts FROM ops_x"""

_HOPS_SQL = """SELECT transaction_hash || '_hop' || CAST(i AS VARCHAR) AS transaction_hash,
  CASE WHEN i = 0 THEN sender ELSE '__path__' || transaction_hash || '_' || CAST(i AS VARCHAR) END AS sender,
  CASE WHEN i = plen THEN cp ELSE '__path__' || transaction_hash || '_' || CAST(i + 1 AS VARCHAR) END AS receiver,
  CASE WHEN i = 0 THEN 'XLM' ELSE 'P' || CAST(i - 1 AS VARCHAR) || ':GP' END AS asset,
  CASE WHEN i = 0 THEN value WHEN i = plen THEN half ELSE NULL END AS amount, ts
FROM ops_x, LATERAL (SELECT UNNEST(range(0, plen + 1)) AS i) h WHERE type = 'path_payment_strict_send'"""


def _norm_out(df):
    return df.select("transaction_hash", "sender", "receiver", "asset", "amount",
                     F.unix_timestamp("timestamp").alias("ts"))


@register("normalize_operations", operators="A9 X6 X7 (asset UNKNOWN without issuer)",
          sql=with_views(_NORM_SQL, "ops_x"), doubles=["amount"])
def q_normalize(spark, sf_dir):
    return _norm_out(ig.normalize_operations(raw_ops(spark, sf_dir)))


@register("normalize_with_hops", operators="A10 A8 (path payment hops)",
          sql=with_views(_NORM_SQL + " WHERE type <> 'path_payment_strict_send' UNION ALL " + _HOPS_SQL, "ops_x"),
          doubles=["amount"])
def q_hops(spark, sf_dir):
    return _norm_out(ig.normalize_with_hops(raw_ops(spark, sf_dir)))


@register("path_payment_hops", operators="A8 (hop flags)",
          sql=with_views("""SELECT transaction_hash, CAST(i AS BIGINT) AS hop_index, i = 0 AS is_first_hop,
  i = plen AS is_last_hop, CASE WHEN i = 0 THEN 'XLM' ELSE 'P' || CAST(i - 1 AS VARCHAR) || ':GP' END AS asset
FROM ops_x, LATERAL (SELECT UNNEST(range(0, plen + 1)) AS i) h WHERE type = 'path_payment_strict_send'""", "ops_x"))
def q_hop_flags(spark, sf_dir):
    return ig.path_payment_hops(raw_ops(spark, sf_dir)).select(
        "transaction_hash", "hop_index", "is_first_hop", "is_last_hop", "asset")


@register("backfill_normalize", operators="A3 A1 (flat rows -> 9 typed columns, first per key)",
          sql=with_views("""SELECT ledger_sequence, operation_id, transaction_hash, type, sender,
  CASE WHEN type = 'change_trust' THEN NULL ELSE cp END AS receiver,
  CASE WHEN type IN ('payment', 'path_payment_strict_send', 'change_trust') THEN ev_asset ELSE 'UNKNOWN' END AS asset,
  CASE type WHEN 'payment' THEN value WHEN 'create_account' THEN value
            WHEN 'path_payment_strict_send' THEN half ELSE NULL END AS amount, ts
FROM ops_x""", "ops_x"), doubles=["amount"])
def q_backfill(spark, sf_dir):
    r = raw_ops(spark, sf_dir)
    flat = ig.parse_json(r, ig.OPERATION_SCHEMA, keep=("seq",)).select("seq", "r.*")
    out = ig.normalize_backfill(flat, order_col="seq")
    return out.withColumn("ts", F.unix_timestamp("timestamp")).drop("timestamp")


@register("parse_operations", operators="A6 (details map, application order)",
          sql=with_views("""SELECT operation_id AS id, transaction_hash,
  CAST(ROW_NUMBER() OVER (PARTITION BY transaction_hash ORDER BY seq) AS BIGINT) AS application_order, type,
  sender AS source_account, CASE WHEN type = 'change_trust' THEN NULL ELSE cp END AS destination_account,
  CASE type WHEN 'payment' THEN value WHEN 'create_account' THEN value
            WHEN 'path_payment_strict_send' THEN half ELSE NULL END AS amount,
  CASE WHEN type IN ('payment', 'path_payment_strict_send', 'change_trust') THEN split_part(ev_asset, ':', 1) END AS asset_code,
  CASE WHEN type IN ('payment', 'path_payment_strict_send', 'change_trust') AND ev_asset <> 'XLM'
       THEN split_part(ev_asset, ':', 2) END AS asset_issuer,
  CAST(CASE type WHEN 'payment' THEN 5 WHEN 'create_account' THEN 4 WHEN 'account_merge' THEN 2
            WHEN 'path_payment_strict_send' THEN 9 ELSE 3 END
       + CASE WHEN type IN ('payment', 'path_payment_strict_send', 'change_trust') AND ev_asset <> 'XLM' THEN 2 ELSE 0 END
       AS BIGINT) AS n_detail_keys,
  ts FROM ops_x""", "ops_x"), doubles=["amount"])
def q_parse_ops(spark, sf_dir):
    p = ig.parse_operations(raw_ops(spark, sf_dir))
    return p.select("id", "transaction_hash", "application_order", "type", "source_account",
                    "destination_account", "amount", "asset_code", "asset_issuer",
                    F.size(F.from_json("details", "map<string,string>")).cast("long").alias("n_detail_keys"),
                    F.unix_timestamp("created_at").alias("ts"))


def _ledger_json(spark, sf_dir):
    """events -> one raw ledger JSON per ledger (event_id div 10 + 1)."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "value")
    g = ev.groupBy((F.floor(F.col("event_id") / 10) + 1).alias("seq")).agg(
        F.max("ts").alias("closed"), F.count(F.lit(1)).alias("n"),
        F.count_distinct(F.floor(F.col("event_id") / 2)).alias("ntx"), F.max("value").alias("mx"))
    rec = F.struct(F.col("seq").cast("string").alias("sequence"),
                   F.sha2(F.col("seq").cast("string"), 256).alias("hash"),
                   F.when(F.col("seq") > 1, F.sha2((F.col("seq") - 1).cast("string"), 256)).alias("prev_hash"),
                   F.date_format("closed", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("closed_at"),
                   F.col("ntx").cast("string").alias("successful_transaction_count"),
                   F.col("n").cast("string").alias("operation_count"),
                   F.format_string("%.7f", F.col("mx")).alias("total_coins"),
                   F.when(F.col("seq") % 2 == 0, F.lit("")).alias("fee_pool"),
                   F.lit("100").alias("base_fee_in_stroops"), F.lit("20").alias("protocol_version"))
    return g.select(F.to_json(rec).alias("raw"))


_LEDGERS_SQL = """SELECT CAST(event_id // 10 + 1 AS BIGINT) AS sequence,
  CAST(COUNT(DISTINCT event_id // 2) AS BIGINT) AS successful_transaction_count,
  CAST(0 AS BIGINT) AS failed_transaction_count, CAST(COUNT(*) AS BIGINT) AS operation_count,
  MAX(value) AS total_coins, CAST(NULL AS DOUBLE) AS fee_pool, CAST(100 AS BIGINT) AS base_fee_in_stroops,
  CAST(20 AS BIGINT) AS protocol_version, CAST(epoch_us(MAX(ts)) // 1000000 AS BIGINT) AS closed_ts
FROM events GROUP BY 1"""


@register("parse_ledgers", operators="A4 (defaults 0, falsy -> null)", sql=_LEDGERS_SQL, doubles=["total_coins", "fee_pool"])
def q_parse_ledgers(spark, sf_dir):
    p = ig.parse_ledgers(_ledger_json(spark, sf_dir))
    return p.select("sequence", "successful_transaction_count", "failed_transaction_count",
                    "operation_count", "total_coins", "fee_pool", "base_fee_in_stroops", "protocol_version",
                    F.unix_timestamp("closed_at").alias("closed_ts"))


# Effect type emitted for each event type in the effect view.
EFFECT_TYPES = {"view": "account_credited", "purchase": "account_debited", "signup": "account_created",
                "click": "trustline_created", "error": "signer_updated"}


_EFFECTS_SQL = f"""SELECT event_id AS id, 'G' || CAST(user_id AS VARCHAR) AS account, et AS type,
  CASE WHEN et IN ('account_created', 'account_credited', 'account_debited') THEN value END AS amount,
  CASE WHEN et IN ('account_created', 'account_credited', 'account_debited')
       THEN CASE WHEN event_type = 'view' THEN 'XLM' ELSE split_part(a, ':', 1) END END AS asset_code,
  CASE WHEN et IN ('account_created', 'account_credited', 'account_debited') AND event_type <> 'view'
       THEN split_part(a, ':', 2) END AS asset_issuer,
  CASE WHEN et = 'account_credited' THEN 'G' || CAST(user_id AS VARCHAR) END AS destination_account
FROM (SELECT *, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in EFFECT_TYPES.items())} END AS et,
             CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_ASSETS.items())} END AS a
      FROM events) e"""


def _effect_json(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts")
    et = None
    for k, v in EFFECT_TYPES.items():
        et = F.when(F.col("event_type") == k, v) if et is None else et.when(F.col("event_type") == k, v)
    a = None
    for k, v in EVENT_ASSETS.items():
        a = F.when(F.col("event_type") == k, v) if a is None else a.when(F.col("event_type") == k, v)
    credit = F.col("event_type") != "view"
    rec = F.struct(F.col("event_id").cast("string").alias("id"),
                   F.concat(F.lit("G"), F.col("user_id").cast("string")).alias("account"), et.alias("type"),
                   F.format_string("%.7f", F.col("value")).alias("amount"),
                   F.when(credit, F.lit("credit_alphanum4")).otherwise(F.lit("native")).alias("asset_type"),
                   F.when(credit, F.split(a, ":").getItem(0)).alias("asset_code"),
                   F.when(credit, F.split(a, ":").getItem(1)).alias("asset_issuer"),
                   F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"))
    return ev.select(F.to_json(rec).alias("raw"))


@register("parse_effects", operators="A7", sql=_EFFECTS_SQL, doubles=["amount"])
def q_parse_effects(spark, sf_dir):
    return ig.parse_effects(_effect_json(spark, sf_dir)).drop("created_at")


_TX_SQL = """tx AS (SELECT transaction_hash, MIN(ledger_sequence) AS ledger_sequence, MIN(ts) AS created_ts
  FROM ops_x GROUP BY transaction_hash),
led AS (SELECT ledger_sequence AS sequence FROM ops_x GROUP BY 1 HAVING MAX(ts_raw) < TIMESTAMP '2024-01-15 00:00:00')"""


def _tx_and_ledgers(spark, sf_dir):
    n = ig.normalize_backfill(ig.parse_json(raw_ops(spark, sf_dir), ig.OPERATION_SCHEMA, keep=("seq",))
                              .select("seq", "r.*"), order_col="seq")
    tx = n.groupBy("transaction_hash").agg(F.min("ledger_sequence").alias("ledger_sequence"),
                                           F.min("timestamp").alias("created_at"))
    led = n.groupBy(F.col("ledger_sequence").alias("sequence")).agg(F.max("timestamp").alias("_mx")) \
        .where(F.unix_timestamp("_mx") < F.lit(CUTOFF_S)).select("sequence")   # an instant, zone-free
    return n, tx, led


@register("ledger_stubs", operators="A13 (missing parent ledgers, null hash)",
          sql=with_views("""SELECT CAST(ledger_sequence AS BIGINT) AS sequence, CAST(NULL AS VARCHAR) AS hash,
  MIN(created_ts) AS closed_ts FROM tx WHERE ledger_sequence NOT IN (SELECT sequence FROM led)
GROUP BY ledger_sequence""", "ops_x", extra=[_TX_SQL]))
def q_stubs(spark, sf_dir):
    _, tx, led = _tx_and_ledgers(spark, sf_dir)
    return ig.ledger_stubs(tx, led).select("sequence", "hash", F.unix_timestamp("closed_at").alias("closed_ts"))


@register("ingest_range", operators="A11 J3 (resolve bounds, skip processed ledgers)",
          sql=with_views("""SELECT CAST(l AS BIGINT) AS ledger,
  CASE WHEN l IN (SELECT sequence FROM led) THEN 'skipped' ELSE 'processed' END AS status
FROM (SELECT UNNEST(range(CAST((SELECT MAX(sequence) FROM led) + 1 - 20 AS BIGINT),
                          CAST((SELECT MAX(ledger_sequence) FROM ops_x) + 1 AS BIGINT))) AS l) r""",
                         "ops_x", extra=[_TX_SQL]))
def q_ingest_range(spark, sf_dir):
    n, _, led = _tx_and_ledgers(spark, sf_dir)
    bounds = led.agg(F.max("sequence")).first()[0], n.agg(F.max("ledger_sequence")).first()[0]
    last_done, last_ledger = bounds
    return ig.ingest_range(n, led.withColumnRenamed("sequence", "ledger"), last_done + 1 - 20, last_ledger, last_done)


@register("ingest_range_payload", operators="A11 (payload join, commit log; a run broken off and repeated, overlapping runs)",
          sql="""WITH l AS (SELECT event_id // 10 + 1 AS sequence, COUNT(*) AS n, MAX(value) AS m FROM events GROUP BY 1)
SELECT CAST(sequence AS BIGINT) AS ledger, CAST(n AS BIGINT) AS operation_count, m AS total_coins FROM l
WHERE sequence BETWEEN 11 AND (SELECT MAX(sequence) FROM l) - 5""", doubles=["total_coins"])
def q_ingest_payload(spark, sf_dir):
    payload = ig.parse_ledgers(_ledger_json(spark, sf_dir)).withColumnRenamed("sequence", "ledger")
    last = payload.agg(F.max("ledger")).first()[0]
    table, step = fl.shared_dir(spark, "ledger-table"), max(1, last // 5)

    def fail(commit: int) -> None:
        if commit == 2:
            raise InterruptedError("broken off between the payload and the commit row")

    try:
        ll.ingest_ledgers(payload, table, 11, 3 * step, ledgers_per_commit=step, before_commit=fail)
    except InterruptedError:
        pass
    ll.ingest_ledgers(payload, table, 11, 3 * step, ledgers_per_commit=step)
    ll.ingest_ledgers(payload, table, None, last - 5, ledgers_per_commit=2 * step)
    return ll.ingested(spark, table).select("ledger", "operation_count", "total_coins")


@register("upsert_last_write", operators="A12 (keyed merge, last write wins)",
          sql=with_views("""SELECT transaction_hash, operation_id, amount, CAST(version AS BIGINT) AS version FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY transaction_hash, operation_id ORDER BY version DESC) AS rn FROM (
    SELECT transaction_hash, operation_id, CASE type WHEN 'payment' THEN value WHEN 'create_account' THEN value
            WHEN 'path_payment_strict_send' THEN half ELSE NULL END AS amount, 1 AS version FROM ops_x
    UNION ALL
    SELECT transaction_hash, operation_id, value * 2, 2 FROM ops_x WHERE type = 'payment') u) t WHERE rn = 1""",
                         "ops_x"), doubles=["amount"])
def q_upsert(spark, sf_dir):
    n, _, _ = _tx_and_ledgers(spark, sf_dir)
    target = n.select("transaction_hash", "operation_id", "amount", F.lit(1).alias("version"))
    batch = n.where(F.col("type") == "payment").select(
        "transaction_hash", "operation_id", (F.col("amount") * 2).alias("amount"), F.lit(2).alias("version"))
    return ig.upsert(target, batch, ["transaction_hash", "operation_id"], "version")


_GRAPH_NORM_SQL = """gn AS (SELECT transaction_hash, type, sender,
  CASE WHEN type = 'change_trust' THEN NULL ELSE cp END AS receiver,
  CASE type WHEN 'payment' THEN value WHEN 'create_account' THEN value
            WHEN 'path_payment_strict_send' THEN half ELSE NULL END AS amount, ts FROM ops_x),
ga AS (SELECT DENSE_RANK() OVER (ORDER BY a) AS id, a AS account_address, MIN(t) AS first_seen_at, MAX(t) AS last_seen_at
  FROM (SELECT sender AS a, ts AS t FROM gn UNION ALL SELECT receiver, ts FROM gn WHERE receiver IS NOT NULL) x GROUP BY a)"""


def _graph_norm(spark, sf_dir):
    n, _, _ = _tx_and_ledgers(spark, sf_dir)
    return n.select("transaction_hash", "type", "sender", "receiver", "amount",
                    F.unix_timestamp("timestamp").alias("ts"))


@register("graph_accounts", operators="A16 (accounts, first/last seen, surrogate id)",
          sql=with_views("SELECT CAST(id AS BIGINT) AS id, account_address, first_seen_at, last_seen_at FROM ga",
                         "ops_x", extra=[_GRAPH_NORM_SQL]))
def q_graph_accounts(spark, sf_dir):
    return ig.graph_accounts(_graph_norm(spark, sf_dir))


@register("graph_edges", operators="A16 (typed edges on surrogate ids, src <> dst check)",
          sql=with_views("""SELECT CASE WHEN gn.type IN ('payment', 'path_payment_strict_send') THEN 'payment' ELSE 'transaction' END AS edge_type,
  CAST(s.id AS BIGINT) AS source_account_id, CAST(COALESCE(d.id, 0) AS BIGINT) AS destination_account_id,
  gn.transaction_hash, gn.amount, gn.ts
FROM gn JOIN ga s ON s.account_address = gn.sender LEFT JOIN ga d ON d.account_address = gn.receiver
WHERE gn.receiver IS NULL OR gn.sender <> gn.receiver""", "ops_x", extra=[_GRAPH_NORM_SQL]),
          doubles=["amount"])
def q_graph_edges(spark, sf_dir):
    g = _graph_norm(spark, sf_dir)
    e = ig.graph_edges(g, ig.graph_accounts(g))
    # 0 stands for "no destination" so the id column stays integral in every client
    return e.withColumn("destination_account_id", F.coalesce("destination_account_id", F.lit(0)))


_MIRROR_SQL = """mtx AS (SELECT lower(lpad(hex(event_id // 2), 64, '0')) AS hash, COUNT(*) AS operation_count, COUNT(*) * 100 AS fee,
  SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) = 0 AS successful, 'm' || CAST(event_id // 2 AS VARCHAR) AS memo
  FROM events GROUP BY event_id // 2),
me AS (SELECT ROW_NUMBER() OVER (ORDER BY ts, x) AS id, m.* FROM (
  SELECT CASE WHEN type IN ('payment', 'path_payment_strict_send') THEN 'payment' ELSE 'transaction' END AS edge_type,
    transaction_hash || ':' || CAST(operation_id AS VARCHAR) AS x, transaction_hash, sender, ts,
    CASE WHEN type = 'change_trust' THEN NULL ELSE cp END AS receiver FROM ops_x) m
  WHERE receiver IS NULL OR sender <> receiver)"""


def _mirror(spark, sf_dir):
    from .catalog_extra import _tx_json
    n, _, _ = _tx_and_ledgers(spark, sf_dir)
    norm = n.select("transaction_hash", "operation_id", "type", "sender", "receiver", "asset", "amount", "ledger_sequence",
                    F.unix_timestamp("timestamp").alias("ts"))
    accounts = ig.graph_accounts(norm)
    return ig.graph_mirror(norm, ig.parse_transactions(_tx_json(spark, sf_dir)), accounts), accounts


@register("graph_payment_details", operators="A16 (payment subtype: reference, status, fee share, settlement)",
          sql=with_views("""SELECT CAST(me.id AS BIGINT) AS edge_id, me.edge_type, me.x AS payment_reference,
  CASE WHEN t.successful THEN 'settled' ELSE 'failed' END AS payment_status, t.fee / t.operation_count AS fee_amount,
  CASE WHEN t.successful THEN me.ts ELSE -1 END AS settled_ts
FROM me JOIN mtx t ON t.hash = me.transaction_hash WHERE me.edge_type = 'payment'""", "ops_x", extra=[_MIRROR_SQL]),
          doubles=["fee_amount"])
def q_payment_details(spark, sf_dir):
    m, _ = _mirror(spark, sf_dir)
    return ig.mirror_table(m, "payment").withColumn("settled_ts", F.coalesce("settled_at", F.lit(-1))).drop("settled_at")


@register("graph_transaction_details", operators="A16 (transaction subtype: success, operations, fee, memo)",
          sql=with_views("""SELECT CAST(me.id AS BIGINT) AS edge_id, me.edge_type, t.successful,
  CAST(t.operation_count AS BIGINT) AS operation_count, CAST(t.fee AS BIGINT) AS fee, 'text' AS memo_type, t.memo
FROM me JOIN mtx t ON t.hash = me.transaction_hash WHERE me.edge_type = 'transaction'""", "ops_x", extra=[_MIRROR_SQL]))
def q_transaction_details(spark, sf_dir):
    return ig.mirror_table(_mirror(spark, sf_dir)[0], "transaction")


@register("graph_mirror_checks", operators="A16 (one write partitioned by edge type, read back, constraints of the tables)",
          sql=with_views("""SELECT * FROM (VALUES ('edge_without_detail', 0), ('detail_without_edge', 0),
  ('edge_with_several_details', 0), ('detail_of_other_type', 0), ('repeated_external_event', 0), ('unknown_edge_type', 0),
  ('edge_to_itself', 0), ('unknown_account', 0), ('negative_fee', 0)) v("check", "rows")
UNION ALL SELECT 'edges ' || edge_type, COUNT(*) FROM me GROUP BY edge_type""", "ops_x", extra=[_MIRROR_SQL]))
def q_mirror_checks(spark, sf_dir):
    m, accounts = _mirror(spark, sf_dir)
    folder = fl.shared_dir(spark, "mirror")
    m.write.partitionBy("edge_type").parquet(folder)
    back = spark.read.parquet(folder)
    details = {t: ig.mirror_table(back, t) for t in ig.EDGE_TYPES}
    counts = back.groupBy(F.concat(F.lit("edges "), "edge_type").alias("check")).agg(F.count(F.lit(1)).alias("rows"))
    return ig.mirror_checks(ig.mirror_table(back, "edges"), details, accounts).unionByName(counts)


@register("asset_registry", operators="A17 (unique code + coalesce(issuer, ''))",
          sql=with_views("""SELECT split_part(ev_asset, ':', 1) AS asset_code, COALESCE(NULLIF(split_part(ev_asset, ':', 2), ''), '') AS asset_issuer,
  CAST(MIN(ledger_sequence) AS BIGINT) AS first_seen_ledger
FROM ops_x WHERE type IN ('payment', 'path_payment_strict_send', 'change_trust') GROUP BY 1, 2""", "ops_x"))
def q_assets(spark, sf_dir):
    r = raw_ops(spark, sf_dir)
    p = ig.parse_operations(r).withColumn("ledger_sequence", F.floor(F.col("id") / 10) + 1)
    return ig.build_assets(p)


@register("latest_account_state", operators="A18 (max_by latest snapshot)",
          sql="""SELECT user_id, arg_max(value, (ts, event_id)) AS balance, arg_max(event_id, (ts, event_id)) AS last_event
FROM events GROUP BY user_id""", doubles=["balance"])
def q_latest(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select("user_id", F.col("value").alias("balance"),
                                                    F.col("event_id").alias("last_event"), "ts")
    return ig.latest_accounts(ev.withColumn("_eid", F.col("last_event")), "user_id", ["ts", "_eid"]) \
        .select("user_id", "balance", "last_event")


@register("memo_features", operators="X4 (memo type, value, length, malformed)",
          sql=r"""SELECT event_id,
  CASE WHEN k IN (3, 4) THEN 'none' ELSE mt END AS memo_type,
  CASE WHEN k = 0 THEN mv
       WHEN k = 1 AND event_type <> 'error' THEN mv
       WHEN k = 2 AND event_type NOT IN ('error') THEN lower(mv) END AS memo_value,
  CAST(CASE WHEN k = 0 THEN length(mv) ELSE 0 END AS BIGINT) AS memo_length,
  CASE WHEN k = 0 THEN false WHEN k IN (1, 2) THEN event_type = 'error' ELSE true END AS is_malformed
FROM (SELECT event_id, event_type, event_id % 5 AS k,
        ['text', 'id', 'hash', 'return', 'text'][(event_id % 5) + 1] AS mt,
        CASE event_id % 5 WHEN 0 THEN 'note ' || CAST(user_id AS VARCHAR)
             WHEN 1 THEN CASE WHEN event_type = 'error' THEN '-' || CAST(event_id AS VARCHAR) ELSE CAST(event_id AS VARCHAR) END
             WHEN 2 THEN CASE WHEN event_type = 'error' THEN 'xyz' WHEN event_type = 'click' THEN upper(sha256(CAST(event_id AS VARCHAR)))
                              ELSE sha256(CAST(event_id AS VARCHAR)) END
             WHEN 3 THEN 'x' END AS mv FROM events) m""")
def q_memo(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    k = F.pmod(F.col("event_id"), F.lit(5))
    mt = F.element_at(F.array(*[F.lit(x) for x in ("text", "id", "hash", "return", "text")]), (k + 1).cast("int"))
    err = F.col("event_type") == "error"
    sha = F.sha2(F.col("event_id").cast("string"), 256)
    mv = (F.when(k == 0, F.concat(F.lit("note "), F.col("user_id").cast("string")))
          .when(k == 1, F.when(err, F.concat(F.lit("-"), F.col("event_id").cast("string")))
                .otherwise(F.col("event_id").cast("string")))
          .when(k == 2, F.when(err, F.lit("xyz")).when(F.col("event_type") == "click", F.upper(sha)).otherwise(sha))
          .when(k == 3, F.lit("x")))
    m = ev.select("event_id", parse_memo(F.when(k != 4, mt), mv).alias("m"))
    return m.select("event_id", F.col("m.type").alias("memo_type"), F.col("m.value").alias("memo_value"),
                    F.col("m.length").cast("long").alias("memo_length"), F.col("m.is_malformed").alias("is_malformed"))


@register("record_hash", operators="X5 (SHA-256 of the canonical record)",
          sql="""SELECT event_id, sha256('id=' || CAST(event_id AS VARCHAR) || chr(31) || 'payload=' || props || chr(31)
  || 'timestamp=' || CAST(epoch_us(ts) // 1000000 AS VARCHAR)) AS tx_hash FROM events""")
def q_record_hash(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    return ev.select("event_id", record_hash({"id": F.col("event_id"), "payload": F.col("props"),
                                             "timestamp": epoch_seconds("ts")}).alias("tx_hash"))
