"""Ingest: parse raw ledger JSON, normalise operations (with path-payment hops), backfill
normalisation, incremental range ingest, keyed upsert, stubs, graph mirror (A3-A18, X6, X7).

Raw records arrive as JSON text, one per row (``raw``), with an ingest-order column.
Parsing is ``from_json`` with a superset schema; absent keys and JSON nulls both read as null.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.assets import build_asset
from ..functions.scalar import parse_iso_timestamp
from ..plans.ordering import with_global_rank

# Path payment operation types.
PATH_PAYMENT_TYPES = ["path_payment_strict_send", "path_payment_strict_receive"]

# Keys every operation carries (everything else goes to ``details``).
OPERATION_COMMON_KEYS = ["id", "paging_token", "transaction_successful", "source_account", "type",
                         "type_i", "created_at", "transaction_hash", "_links"]

_S = T.StringType()
ASSET_STRUCT = T.StructType([T.StructField(n, _S) for n in ("asset_type", "asset_code", "asset_issuer")])
OPERATION_SCHEMA = T.StructType(
    [T.StructField(n, _S) for n in (
        "id", "paging_token", "type", "source_account", "created_at", "transaction_hash", "to",
        "from", "amount", "asset_type", "asset_code", "asset_issuer", "account", "funder",
        "starting_balance", "into", "destination_account", "source_amount", "destination_amount",
        "source_asset_type", "source_asset_code", "source_asset_issuer", "trustor", "ledger",
        "ledger_sequence", "sequence", "closed_at", "timestamp", "hash")]
    + [T.StructField("type_i", T.LongType()), T.StructField("path", T.ArrayType(ASSET_STRUCT))])

LEDGER_SCHEMA = T.StructType([T.StructField(n, _S) for n in (
    "sequence", "hash", "prev_hash", "closed_at", "successful_transaction_count",
    "failed_transaction_count", "operation_count", "total_coins", "fee_pool",
    "base_fee_in_stroops", "protocol_version")])

TRANSACTION_SCHEMA = T.StructType([T.StructField(n, _S) for n in (
    "hash", "ledger", "source_account", "created_at", "fee_charged", "operation_count",
    "successful", "memo_type", "memo")])

EFFECT_SCHEMA = T.StructType([T.StructField(n, _S) for n in (
    "id", "account", "type", "amount", "asset_type", "asset_code", "asset_issuer", "created_at")])


def parse_json(raw: DataFrame, schema: T.StructType, raw_col: str = "raw", keep: tuple = (),
               drop_malformed: bool = False) -> DataFrame:
    """Decode JSON text with a schema into the struct column ``r``.

    Malformed text decodes to null.  With ``drop_malformed`` such rows are removed through a
    generator (``explode`` of a 0/1-element array) rather than a filter: a filter on the
    decoded struct would be pushed below the projection and decode every record twice."""
    decoded = F.from_json(F.col(raw_col), schema)
    if drop_malformed:
        return raw.select(*keep, F.explode(F.filter(F.array(decoded), lambda x: x.isNotNull())).alias("r"))
    return raw.select(*keep, decoded.alias("r"))


def _falsy_to_null(c: Column) -> Column:
    """null, empty text and a bare JSON 0 are falsy; a text such as "0.0000000" is not."""
    return F.when(c.isNull() | (c == "") | (c == "0"), F.lit(None)).otherwise(c)


def parse_ledgers(raw: DataFrame, raw_col: str = "raw") -> DataFrame:
    """A4: ints cast, counts default 0, falsy coins / fee pool / base fee / protocol -> null."""
    r = parse_json(raw, LEDGER_SCHEMA, raw_col, drop_malformed=True).select("r.*")
    return r.select(
        F.col("sequence").try_cast("long").alias("sequence"), "hash", "prev_hash",
        parse_iso_timestamp(F.col("closed_at")).alias("closed_at"),
        *[F.coalesce(F.col(c).try_cast("int"), F.lit(0)).alias(c) for c in (
            "successful_transaction_count", "failed_transaction_count", "operation_count")],
        _falsy_to_null(F.col("total_coins")).try_cast("double").alias("total_coins"),
        _falsy_to_null(F.col("fee_pool")).try_cast("double").alias("fee_pool"),
        _falsy_to_null(F.col("base_fee_in_stroops")).try_cast("int").alias("base_fee_in_stroops"),
        _falsy_to_null(F.col("protocol_version")).try_cast("int").alias("protocol_version"))


def parse_transactions(raw: DataFrame, raw_col: str = "raw") -> DataFrame:
    """A5: ``ledger`` -> ledger_sequence, ``fee_charged`` -> fee."""
    r = parse_json(raw, TRANSACTION_SCHEMA, raw_col, drop_malformed=True).select("r.*")
    return r.select("hash", F.col("ledger").try_cast("long").alias("ledger_sequence"),
                    "source_account", parse_iso_timestamp(F.col("created_at")).alias("created_at"),
                    F.col("fee_charged").try_cast("long").alias("fee"),
                    F.col("operation_count").try_cast("int").alias("operation_count"),
                    (F.lower(F.col("successful")) == "true").alias("successful"),
                    "memo_type", "memo")


def _destination(r: str = "r") -> Column:
    typ = F.col(f"{r}.type")
    return F.coalesce(F.col(f"{r}.to"),
                      F.when(typ == "create_account", F.col(f"{r}.account")),
                      F.when(typ == "account_merge", F.col(f"{r}.into")),
                      F.col(f"{r}.destination_account"))


def _amount_text(r: str = "r") -> Column:
    return F.coalesce(*[F.col(f"{r}.{c}") for c in ("amount", "starting_balance", "destination_amount",
                                                    "source_amount")])


def parse_operations(raw: DataFrame, raw_col: str = "raw", seq_col: str = "seq", keep: tuple = ()) -> DataFrame:
    """Operation rows; ``details`` = JSON of all non-common keys (null if none);
    application_order = position in the transaction by ingest order (1-based); columns of ``raw`` to ``keep``."""
    both = F.struct(F.from_json(F.col(raw_col), OPERATION_SCHEMA).alias("r"),
                    F.from_json(F.col(raw_col), "map<string,string>").alias("_m"))
    m = raw.select(seq_col, *keep, F.explode(F.filter(F.array(both), lambda x: x["r"].isNotNull())).alias("_d")) \
        .select(seq_col, *keep, "_d.r", "_d._m")
    details = F.map_filter("_m", lambda k, v: ~k.isin(OPERATION_COMMON_KEYS))
    w = Window.partitionBy("r.transaction_hash").orderBy(seq_col)
    asset_native = F.col("r.asset_type") == "native"
    return m.select(
        F.col("r.id").try_cast("long").alias("id"), F.col("r.transaction_hash").alias("transaction_hash"),
        F.row_number().over(w).alias("application_order"), F.col("r.type").alias("type"),
        F.col("r.source_account").alias("source_account"), _destination().alias("destination_account"),
        _amount_text().try_cast("double").alias("amount"),
        F.when(asset_native, F.lit("XLM")).otherwise(F.col("r.asset_code")).alias("asset_code"),
        F.when(asset_native, F.lit(None)).otherwise(F.col("r.asset_issuer")).alias("asset_issuer"),
        parse_iso_timestamp(F.col("r.created_at")).alias("created_at"),
        F.when(F.size(details) > 0, F.to_json(details)).alias("details"), *keep)


def parse_effects(raw: DataFrame, raw_col: str = "raw") -> DataFrame:
    """amount/asset only for account_created/credited/debited (native -> XLM);
    destination = account when credited."""
    r = parse_json(raw, EFFECT_SCHEMA, raw_col, drop_malformed=True).select("r.*")
    money = F.col("type").isin("account_created", "account_credited", "account_debited") \
        & F.col("amount").isNotNull() & (F.col("amount") != "")
    return r.select(F.col("id").try_cast("long").alias("id"), "account", "type",
                    F.when(money, F.col("amount").try_cast("double")).alias("amount"),
                    F.when(money, F.when(F.col("asset_type") == "native", F.lit("XLM"))
                           .otherwise(F.col("asset_code"))).alias("asset_code"),
                    F.when(money & (F.col("asset_type") != "native"), F.col("asset_issuer")).alias("asset_issuer"),
                    F.when(F.col("type") == "account_credited", F.col("account")).alias("destination_account"),
                    parse_iso_timestamp(F.col("created_at")).alias("created_at"))


def _parsed(raw: DataFrame, raw_col: str) -> DataFrame:
    """``raw`` as a frame with the decoded, non-null struct ``r`` (reused when already decoded)."""
    if "r" in raw.columns and raw_col not in raw.columns:
        return raw
    return parse_json(raw, OPERATION_SCHEMA, raw_col, drop_malformed=True)


def normalize_operations(raw: DataFrame, raw_col: str = "raw") -> DataFrame:
    """(transaction_hash, sender, receiver, asset, amount, timestamp) per operation.
    asset = XLM for native, code:issuer when both are present, else UNKNOWN (D19)."""
    r = _parsed(raw, raw_col)
    return r.select(F.col("r.transaction_hash").alias("transaction_hash"),
                    F.col("r.source_account").alias("sender"), _destination().alias("receiver"),
                    build_asset(F.col("r.asset_type"), F.col("r.asset_code"), F.col("r.asset_issuer"),
                                code_only_ok=False).alias("asset"),
                    _amount_text().try_cast("double").alias("amount"),
                    parse_iso_timestamp(F.col("r.created_at")).alias("timestamp"),
                    F.col("r.type").alias("type"), F.col("r.id").try_cast("long").alias("operation_id"))


def _asset_text(t: Column, code: Column, issuer: Column) -> Column:
    """Hop asset: native -> XLM, code:issuer when an issuer is given, else code (UNKNOWN if none)."""
    c = F.coalesce(code, F.lit("UNKNOWN"))
    return F.when(t == "native", F.lit("XLM")).when(
        issuer.isNotNull() & (issuer != ""), F.concat_ws(":", c, issuer)).otherwise(c)


def path_payment_hops(raw: DataFrame, raw_col: str = "raw") -> DataFrame:
    """One row per hop of a path payment.

    chain = [source asset] + path assets + [destination asset]; hop i goes from the sender (i=0)
    or ``__path__{hash}_{i}`` to the receiver (last) or ``__path__{hash}_{i+1}``; amount = source
    amount on hop 0, destination amount on the last hop, null between (one hop: source)."""
    r = _parsed(raw, raw_col).where(F.col("r.type").isin(PATH_PAYMENT_TYPES)).select("r.*")
    src_asset = _asset_text(F.coalesce(F.col("source_asset_type"), F.col("asset_type"), F.lit("")),
                            F.coalesce(F.col("source_asset_code"), F.col("asset_code")),
                            F.coalesce(F.col("source_asset_issuer"), F.col("asset_issuer")))
    dst_asset = _asset_text(F.coalesce(F.col("asset_type"), F.lit("")), F.col("asset_code"), F.col("asset_issuer"))
    path_assets = F.transform(F.coalesce(F.col("path"), F.array().cast(T.ArrayType(ASSET_STRUCT))),
                              lambda p: _asset_text(p["asset_type"], p["asset_code"], p["asset_issuer"]))
    chain = F.concat(F.array(src_asset), path_assets, F.array(dst_asset))
    x = r.select("transaction_hash", "source_account", "id",
                 F.coalesce(F.col("to"), F.col("destination_account")).alias("_recv"),
                 "created_at", "source_amount",
                 F.coalesce(F.col("destination_amount"), F.col("amount")).alias("_dst_amount"),
                 chain.alias("_chain"))
    x = x.select("*", F.posexplode(F.slice("_chain", 1, F.size("_chain") - 1)).alias("hop_index", "asset"))
    n = F.size("_chain") - 1
    i = F.col("hop_index")
    pref = F.concat(F.lit("__path__"), F.col("transaction_hash"), F.lit("_"))
    return x.select(
        "transaction_hash",
        F.when(i == 0, F.col("source_account")).otherwise(F.concat(pref, i.cast("string"))).alias("from_account"),
        F.when(i == n - 1, F.col("_recv")).otherwise(F.concat(pref, (i + 1).cast("string"))).alias("to_account"),
        "asset",
        F.when(i == 0, F.col("source_amount")).when(i == n - 1, F.col("_dst_amount"))
         .try_cast("double").alias("amount"),
        i.cast("long").alias("hop_index"), (i == 0).alias("is_first_hop"), (i == n - 1).alias("is_last_hop"),
        "created_at", F.col("id").try_cast("long").alias("operation_id"))


def normalize_with_hops(raw: DataFrame, raw_col: str = "raw") -> DataFrame:
    """A10: path payments -> one row per hop with hash '{hash}_hop{i}'; others -> A9.

    One pass: every decoded operation yields an array of output rows (its hops, or its single
    A9 row) and one ``explode`` emits them - one scan and one JSON decode per record."""
    r = _parsed(raw, raw_col)
    ts = parse_iso_timestamp(F.col("r.created_at"))
    op_id = F.col("r.id").try_cast("long")
    plain = F.struct(F.col("r.transaction_hash").alias("transaction_hash"), F.col("r.source_account").alias("sender"),
                     _destination().alias("receiver"),
                     build_asset(F.col("r.asset_type"), F.col("r.asset_code"), F.col("r.asset_issuer"),
                                 code_only_ok=False).alias("asset"),
                     _amount_text().try_cast("double").alias("amount"), ts.alias("timestamp"), op_id.alias("operation_id"))
    src_asset = _asset_text(F.coalesce(F.col("r.source_asset_type"), F.col("r.asset_type"), F.lit("")),
                            F.coalesce(F.col("r.source_asset_code"), F.col("r.asset_code")),
                            F.coalesce(F.col("r.source_asset_issuer"), F.col("r.asset_issuer")))
    dst_asset = _asset_text(F.coalesce(F.col("r.asset_type"), F.lit("")), F.col("r.asset_code"), F.col("r.asset_issuer"))
    path_assets = F.transform(F.coalesce(F.col("r.path"), F.array().cast(T.ArrayType(ASSET_STRUCT))),
                              lambda p: _asset_text(p["asset_type"], p["asset_code"], p["asset_issuer"]))
    chain = F.concat(F.array(src_asset), path_assets, F.array(dst_asset))
    n = F.size(chain) - 1
    h = F.col("r.transaction_hash")
    recv = F.coalesce(F.col("r.to"), F.col("r.destination_account"))
    dst_amount = F.coalesce(F.col("r.destination_amount"), F.col("r.amount"))
    pref = F.concat(F.lit("__path__"), h, F.lit("_"))

    def hop(i):
        return F.struct(
            F.concat(h, F.lit("_hop"), i.cast("string")).alias("transaction_hash"),
            F.when(i == 0, F.col("r.source_account")).otherwise(F.concat(pref, i.cast("string"))).alias("sender"),
            F.when(i == n - 1, recv).otherwise(F.concat(pref, (i + 1).cast("string"))).alias("receiver"),
            F.element_at(chain, (i + 1).cast("int")).alias("asset"),
            F.when(i == 0, F.col("r.source_amount")).when(i == n - 1, dst_amount).try_cast("double").alias("amount"),
            ts.alias("timestamp"), op_id.alias("operation_id"))
    rows = F.when(F.col("r.type").isin(PATH_PAYMENT_TYPES), F.transform(F.sequence(F.lit(0), n - 1), hop)) \
        .otherwise(F.array(plain))
    return r.select(F.explode(rows).alias("o")).select("o.*")


# The columns of the normalised backfill.
BACKFILL_COLUMNS = ["ledger_sequence", "operation_id", "transaction_hash", "type", "sender", "receiver",
                    "asset", "amount", "timestamp"]


def normalize_backfill(rows: DataFrame, order_col: str) -> DataFrame:
    """A3: normalise raw backfill rows (flat columns, any subset; missing ones read as null).

    sender = coalesce(source_account, from, funder); receiver = coalesce(to, account if
    create_account, into if account_merge, destination_account); amount = first of amount,
    starting_balance, destination_amount, source_amount (non-strict double); asset XLM /
    code:issuer / code / UNKNOWN; ledger = coalesce(ledger_sequence, ledger, sequence);
    timestamp = coalesce(created_at, closed_at, timestamp) as UTC; hash = coalesce(transaction_hash,
    hash).  Rows missing ledger, sender, hash or timestamp are dropped; (hash, operation_id)
    keeps its first row by ``order_col``, which must be given: without an order there is no first
    row.  Rows with a null hash and id are many; the grouped minimum combines them map-side.
    """
    names = set(rows.columns)

    def c(name):
        return F.col(f"`{name}`").cast("string") if name in names else F.lit(None).cast("string")
    typ = c("type")
    x = rows.select(
        F.col(order_col).alias("_ord"),
        F.coalesce(c("ledger_sequence"), c("ledger"), c("sequence")).try_cast("long").alias("ledger_sequence"),
        c("id").try_cast("long").alias("operation_id"),
        F.coalesce(c("transaction_hash"), c("hash")).alias("transaction_hash"),
        typ.alias("type"),
        F.coalesce(c("source_account"), c("from"), c("funder")).alias("sender"),
        F.coalesce(c("to"), F.when(typ == "create_account", c("account")),
                   F.when(typ == "account_merge", c("into")), c("destination_account")).alias("receiver"),
        build_asset(c("asset_type"), c("asset_code"), c("asset_issuer"), code_only_ok=True).alias("asset"),
        F.coalesce(c("amount"), c("starting_balance"), c("destination_amount"), c("source_amount"))
         .try_cast("double").alias("amount"),
        parse_iso_timestamp(F.coalesce(c("created_at"), c("closed_at"), c("timestamp"))).alias("timestamp"))
    valid = (F.col("ledger_sequence").isNotNull() & F.col("sender").isNotNull()
             & F.col("transaction_hash").isNotNull() & F.col("timestamp").isNotNull())
    # "drop invalid rows, then keep the first row per key" == "first row per key ordered by
    # (valid first, ingest order), kept when valid".  Written this way no filter sits on the
    # parsed fields, so the optimizer cannot push one below the projection and decode the
    # records a second time in the scan stage.
    keys = ["transaction_hash", "operation_id"]
    rest = [n for n in BACKFILL_COLUMNS if n not in keys]
    first = x.groupBy(*keys).agg(F.min_by(F.struct(valid.alias("_valid"), *rest), F.struct((~valid).alias("_late"), "_ord")).alias("_r"))
    return first.where("_r._valid").select(*keys, "_r.*").select(*BACKFILL_COLUMNS)


def resolve_range(start: int | None, end: int | None, last_processed: int | None) -> tuple[int, int] | None:
    """A11 bounds: none -> last + 1 only; no start -> last + 1; no end -> start; nothing known -> None;
    end < start raises."""
    if start is None and end is None:
        if last_processed is None:
            return None
        start = end = last_processed + 1
    if start is None and last_processed is not None:
        start = last_processed + 1
    if end is None and start is not None:
        end = start
    if start is None or end is None:
        return None
    if end < start:
        raise ValueError("end_ledger must be >= start_ledger")
    return start, end


def ingest_range(ledgers: DataFrame, processed: DataFrame, start: int | None, end: int | None,
                 last_processed: int | None) -> DataFrame:
    """(ledger, status) for the resolved range: 'skipped' if already processed, 'missing' if
    ``ledgers`` (column sequence, or ledger_sequence) has no such ledger, else 'processed'.  With
    payload and commits: :mod:`ledgerloom.sources.ledger_log`."""
    spark = processed.sparkSession
    bounds = resolve_range(start, end, last_processed)
    if bounds is None:
        return spark.createDataFrame([], "ledger long, status string")
    rng = spark.range(bounds[0], bounds[1] + 1).select(F.col("id").alias("ledger"))
    done = processed.select(F.col("ledger").cast("long")).distinct().withColumn("_done", F.lit(True))
    number = "sequence" if "sequence" in ledgers.columns else "ledger_sequence"
    there = ledgers.select(F.col(number).cast("long").alias("ledger")).distinct().withColumn("_there", F.lit(True))
    return rng.join(done, "ledger", "left").join(there, "ledger", "left").select(
        "ledger", F.when(F.col("_done"), "skipped").when(F.col("_there"), "processed").otherwise("missing").alias("status"))


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """Keyed merge, last write wins (largest ``order_col``; batch after target on ties)."""
    u = target.withColumn("_src", F.lit(0)).unionByName(batch.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    names = [c for c in u.columns if c != "_src"]
    rest = [c for c in names if c not in keys]
    g = u.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order_col, "_src")).alias("_r"))
    return g.select(*keys, "_r.*").select(*names)


def ledger_stubs(tx: DataFrame, ledgers: DataFrame) -> DataFrame:
    """Missing parent ledgers for transactions: sequence, closed_at = earliest tx time,
    null hash (D8)."""
    need = tx.groupBy(F.col("ledger_sequence").alias("sequence")).agg(F.min("created_at").alias("closed_at"))
    return (need.join(ledgers.select("sequence"), "sequence", "left_anti")
            .select("sequence", F.lit(None).cast("string").alias("hash"), "closed_at"))


def graph_accounts(norm: DataFrame) -> DataFrame:
    """One row per account address with first/last seen and a dense surrogate id (1-based,
    address order) from a range-partitioned rank, not a single-partition window."""
    ep = norm.select(F.explode(F.array(
        F.struct(F.col("sender").alias("a"), F.col("ts").alias("t")),
        F.struct(F.col("receiver").alias("a"), F.col("ts").alias("t")))).alias("e")).select("e.*") \
        .where(F.col("a").isNotNull())
    acc = ep.groupBy(F.col("a").alias("account_address")).agg(
        F.min("t").alias("first_seen_at"), F.max("t").alias("last_seen_at"))
    return with_global_rank(acc, ["account_address"], "_r").select(
        (F.col("_r") + 1).alias("id"), "account_address", "first_seen_at", "last_seen_at")


def graph_edges(norm: DataFrame, accounts: DataFrame) -> DataFrame:
    """Typed edges keyed by surrogate account ids; edge_type 'payment' for payment and path
    payment, 'transaction' otherwise; the src <> dst check drops self pairs, a null receiver
    keeps a null destination id."""
    a = accounts.select("id", "account_address")
    s = a.select(F.col("id").alias("source_account_id"), F.col("account_address").alias("sender"))
    d = a.select(F.col("id").alias("destination_account_id"), F.col("account_address").alias("receiver"))
    e = norm.where(F.col("receiver").isNull() | (F.col("sender") != F.col("receiver")))
    return (e.join(s, "sender").join(d, "receiver", "left")
            .select(F.when(F.col("type").isin("payment", *PATH_PAYMENT_TYPES), F.lit("payment"))
                    .otherwise(F.lit("transaction")).alias("edge_type"),
                    "source_account_id", "destination_account_id", "transaction_hash", "amount", "ts"))


# Edge types of the mirror and the operation types that make them.
EDGE_TYPES = ["transaction", "claim", "payment"]
CLAIM_TYPES = ["create_claimable_balance", "claim_claimable_balance", "clawback_claimable_balance"]


def edge_type(op_type: Column) -> Column:
    return (F.when(op_type.isin("payment", *PATH_PAYMENT_TYPES), "payment")
            .when(op_type.isin(*CLAIM_TYPES), "claim").otherwise("transaction"))


def graph_mirror(norm: DataFrame, tx: DataFrame, accounts: DataFrame) -> DataFrame:
    """Every edge of the mirror with its details, from one pass over the operations.

    norm(transaction_hash, operation_id, type, sender, receiver, asset, amount, ts, ledger_sequence), tx =
    parsed transactions, accounts = :func:`graph_accounts`.  An edge has a surrogate id (rank by time and
    event), surrogate account ids, ``external_event_id`` = hash:operation, unique per type, and exactly
    one of the structs ``payment``, ``claim``, ``transaction``; the tables are projections of this one
    (:func:`mirror_table`).  Self pairs make no edge; a null receiver keeps a null destination."""
    e = norm.where(F.col("receiver").isNull() | (F.col("sender") != F.col("receiver"))).select(
        edge_type(F.col("type")).alias("edge_type"),
        F.concat_ws(":", "transaction_hash", F.col("operation_id").cast("string")).alias("external_event_id"),
        "transaction_hash", "operation_id", F.col("type").alias("operation_type"), "sender", "receiver", "asset", "amount",
        F.col("ts").alias("occurred_at"), "ledger_sequence")
    ids = accounts.select("id", "account_address")
    e = e.join(ids.select(F.col("account_address").alias("sender"), F.col("id").alias("source_account_id")), "sender")
    e = e.join(ids.select(F.col("account_address").alias("receiver"), F.col("id").alias("destination_account_id")),
               "receiver", "left")
    t = tx.select(F.col("hash").alias("transaction_hash"), "successful", "operation_count", "fee", "memo_type", "memo")
    e = e.join(t, "transaction_hash", "left")
    status = F.when(F.col("successful"), "settled").when(~F.col("successful"), "failed")
    share = F.col("fee") / F.greatest(F.col("operation_count"), F.lit(1))
    payment = F.struct(F.col("external_event_id").alias("payment_reference"), status.alias("payment_status"),
                       share.alias("fee_amount"), F.when(F.col("successful"), F.col("occurred_at")).alias("settled_at"))
    claim = F.struct(F.col("external_event_id").alias("claim_reference"),
                     F.when(F.col("operation_type") == "create_claimable_balance", "open")
                     .when(F.col("operation_type") == "claim_claimable_balance", "claimed").otherwise("clawed_back").alias("claim_status"))
    other = F.struct("successful", "operation_count", "fee", "memo_type", "memo")
    is_type = lambda t: F.col("edge_type") == t
    e = e.select("edge_type", "external_event_id", "transaction_hash", "operation_id", "source_account_id",
                 "destination_account_id", "asset", "amount", "occurred_at", "ledger_sequence",
                 F.when(is_type("payment"), payment).alias("payment"), F.when(is_type("claim"), claim).alias("claim"),
                 F.when(is_type("transaction"), other).alias("transaction"))
    ranked = with_global_rank(e, ["occurred_at", "external_event_id"], "_r")
    return ranked.withColumn("id", F.col("_r") + 1).drop("_r")


MIRROR_EDGE = ["id", "edge_type", "external_event_id", "transaction_hash", "source_account_id", "destination_account_id",
               "asset", "amount", "occurred_at", "ledger_sequence"]


def mirror_table(mirror: DataFrame, name: str) -> DataFrame:
    """``edges``, or the detail table of an edge type (edge_id, edge_type, its columns)."""
    if name == "edges":
        return mirror.select(*MIRROR_EDGE)
    if name not in EDGE_TYPES:
        raise ValueError(f"no mirror table {name!r}")
    return mirror.where(F.col(name).isNotNull()).select(F.col("id").alias("edge_id"), "edge_type", f"{name}.*")


def mirror_checks(edges: DataFrame, details: dict[str, DataFrame], accounts: DataFrame) -> DataFrame:
    """(check, rows) of the constraints of the mirror's tables, as they were stored: number of rows that
    break each of them."""
    held = None
    for name, d in details.items():
        one = d.select(F.col("edge_id").alias("id"), F.col("edge_type").alias("detail_type"), F.lit(name).alias("table"))
        held = one if held is None else held.unionByName(one)
    kinds = [f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("detail_type", "table")]
    per_edge = held.groupBy("id").agg(F.count(F.lit(1)).alias("n"), *kinds)
    j = edges.select("id", "edge_type").withColumn("_e", F.lit(True)).join(per_edge, "id", "full")
    one = j.agg(*[F.count(F.when(c, 1)).alias(n) for n, c in {
        "edge_without_detail": F.col("_e") & F.col("n").isNull(), "detail_without_edge": F.col("_e").isNull(),
        "edge_with_several_details": F.col("n") > 1,
        "detail_of_other_type": F.least("min_detail_type", "min_table", "edge_type")
        != F.greatest("max_detail_type", "max_table", "edge_type")}.items()])
    twice = edges.groupBy("edge_type", "external_event_id").agg((F.count(F.lit(1)) - 1).alias("more")).agg(
        F.coalesce(F.sum("more"), F.lit(0)).alias("repeated_external_event"))
    ends = edges.agg(
        F.count(F.when(~F.col("edge_type").isin(*EDGE_TYPES), 1)).alias("unknown_edge_type"),
        F.count(F.when(F.col("source_account_id") == F.col("destination_account_id"), 1)).alias("edge_to_itself"))
    known = accounts.select(F.col("id").alias("account"))
    ids = edges.select(F.explode(F.array("source_account_id", "destination_account_id")).alias("account")).where(
        "account is not null").join(known, "account", "left_anti").agg(F.count(F.lit(1)).alias("unknown_account"))
    wide = [one, twice, ends, ids]
    if "payment" in details:
        wide.append(details["payment"].agg(F.count(F.when(F.col("fee_amount") < 0, 1)).alias("negative_fee")))
    rows = [w.select(F.explode(F.create_map(*[x for c in w.columns for x in (F.lit(c), F.col(c).cast("long"))]))
                     .alias("check", "rows")) for w in wide]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def build_assets(ops: DataFrame) -> DataFrame:
    """One row per (asset_code, coalesce(asset_issuer, '')) with the first ledger seen."""
    o = ops.where(F.col("asset_code").isNotNull())
    return o.groupBy("asset_code", F.coalesce(F.col("asset_issuer"), F.lit("")).alias("asset_issuer")) \
        .agg(F.min("ledger_sequence").alias("first_seen_ledger"))


def latest_accounts(snapshots: DataFrame, key: str, order_cols: list[str]) -> DataFrame:
    """Latest snapshot per account (``max_by`` over a struct of the order columns, a
    partial aggregate - no window over a possibly huge account)."""
    cols = [c for c in snapshots.columns if c != key]
    order = F.struct(*[F.col(c) for c in order_cols])
    return snapshots.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("_l")).select(key, "_l.*")
