"""Edge and record views derived from the driver tables.

The driver tables have no ledger, so the account-graph operators run on views derived
from them.  Every view is defined twice: as a Spark plan (used by the queries) and as a
DuckDB CTE (used by the oracle SQL).  Both must stay in step.

``acct_edges``  events -> payment-like edges: src = user_id, dst = user_id of the next event
                of the same event_type (order ts, event_id); self pairs dropped.
``trade_edges`` orders x lineitem -> customer -> supplier edges (bipartite, high volume).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import read_table, spread

# Asset assigned to each event type in the edge view.
EVENT_ASSETS = {
    "view": "XLM",
    "click": "USDC:GA",
    "purchase": "EURC:GB",
    "signup": "ABC:GC",
    "error": "XYZ:GD",
}

EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def epoch_micros(col: str = "ts"):
    """Epoch microseconds of a timestamp_ntz column read as UTC wall time.

    Built from the value's own fields (days since 1970, hour, minute, second with fraction), so
    the result never depends on the session time zone or its daylight-saving rules."""
    return F.expr(f"unix_date(cast({col} as date)) * 86400000000L + (hour({col}) * 3600L + minute({col}) * 60L)"
                  f" * 1000000L + cast(extract(SECOND FROM {col}) * 1000000 as bigint)")


def epoch_seconds(col: str = "ts"):
    """Whole epoch seconds of a timestamp_ntz column (UTC wall time), zone-independent."""
    return F.floor(epoch_micros(col) / 1000000).cast("long")


def _asset_col(col: str = "event_type"):
    expr = None
    for k, v in EVENT_ASSETS.items():
        expr = F.when(F.col(col) == k, v) if expr is None else expr.when(F.col(col) == k, v)
    return expr


def next_in_sequence(df: DataFrame, group_cols: list[str], order_cols: list[str], value_col: str,
                     out_col: str, bucket_col: str) -> DataFrame:
    """``lead(value) over (partition by group order by order_cols)`` without one task per group.

    A plain window puts every row of a group into one task; a group may hold a third of the
    data.  Rows are instead windowed per (group, bucket), where ``bucket_col`` is monotone in
    the order (e.g. a time bucket).  The last row of a bucket takes the first row of the next
    non-empty bucket of its group; that table has one row per (group, bucket), is built by a
    partial aggregate and is small relative to the data.
    """
    keys = group_cols + [bucket_col]
    w = Window.partitionBy(*keys).orderBy(*order_cols)
    local = (df.withColumn(out_col, F.lead(value_col).over(w))
             .withColumn("_is_first", F.lag(F.lit(1)).over(w).isNull()))
    # first row of every bucket comes from the same window pass (no second scan); one row per
    # (group, bucket), so the lead over buckets runs on a small table
    firsts = local.where(F.col("_is_first")).select(*keys, F.col(value_col).alias("_first"))
    wb = Window.partitionBy(*group_cols).orderBy(bucket_col)
    nxt = firsts.select(*keys, F.lead("_first").over(wb).alias("_next_first"))
    return (local.drop("_is_first").join(nxt, keys, "left")
            .withColumn(out_col, F.coalesce(F.col(out_col), F.col("_next_first")))
            .drop("_next_first"))


def acct_edges(spark: SparkSession, sf_dir: str, bucket_seconds: int = 3600,
               keep_all: bool = False) -> DataFrame:
    """events -> (src, dst, amount, ts, asset, edge_id) edge view, see module doc.

    ``keep_all`` keeps self pairs and the null dst of the last event of each type (used by
    the graph-consistency checks)."""
    ev = (read_table(spark, sf_dir, "events")
          .select("event_id", "ts", "user_id", "event_type", "value")
          .withColumn("_bucket", epoch_seconds("ts") / bucket_seconds)
          .withColumn("_bucket", F.floor("_bucket")))
    nx = next_in_sequence(ev, ["event_type"], ["ts", "event_id"], "user_id", "_next_user", "_bucket")
    if not keep_all:
        nx = nx.where(F.col("_next_user").isNotNull() & (F.col("_next_user") != F.col("user_id")))
    return (nx.select(F.col("user_id").cast("string").alias("src"),
                    F.col("_next_user").cast("string").alias("dst"),
                    F.col("value").alias("amount"),
                    epoch_seconds("ts").alias("ts"),
                    _asset_col().alias("asset"),
                    F.col("event_id").alias("edge_id")))


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders x lineitem -> (src='c'||custkey, dst='s'||suppkey, amount, ts, asset, edge_id)."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate",
                                                    "o_orderpriority")
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber",
                                                       "l_extendedprice")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"),
                    F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"),
                    F.col("l_extendedprice").alias("amount"),
                    epoch_seconds("o_orderdate").alias("ts"),
                    F.col("o_orderpriority").alias("asset"),
                    (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("edge_id"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> (id, ts, tie, y_true, y_prob, y_pred): a deterministic scored table.

    y_true = event is an error; y_prob = 0.7 * (pmod(event_id * 7919, 1000) / 1000) + 0.3 * y_true;
    y_pred = y_prob >= 0.5."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    y = (F.col("event_type") == "error").cast("int")
    p = F.lit(0.7) * (F.pmod(F.col("event_id") * 7919, F.lit(1000)) / F.lit(1000.0)) + F.lit(0.3) * y
    return ev.select(F.col("event_id").alias("id"), F.col("user_id").alias("account"),
                     epoch_seconds("ts").alias("ts"), y.alias("y_true"), p.alias("y_prob")) \
             .withColumn("y_pred", (F.col("y_prob") >= 0.5).cast("int"))


OP_TYPES = ["payment", "create_account", "account_merge", "path_payment_strict_send", "change_trust"]


def raw_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> raw operation records as JSON text (``raw``) with an ingest order ``seq``.

    type = OP_TYPES[event_id mod 5]; source 'G'||user_id; counterparty 'G'||((user_id*7 +
    event_id) mod 1000); amount = value with 7 decimals; path payments send ``value`` of XLM
    and deliver value/2 of the event asset through (event_id div 5) mod 3 intermediate assets
    'P<i>:GP'; two operations per transaction hash, ten per ledger.  Absent fields are
    omitted from the JSON (``to_json`` drops nulls)."""
    ev = spread(read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value"))
    k = F.pmod(F.col("event_id"), F.lit(5))
    typ = F.element_at(F.array(*[F.lit(t) for t in OP_TYPES]), (k + 1).cast("int"))
    src = F.concat(F.lit("G"), F.col("user_id").cast("string"))
    dst = F.concat(F.lit("G"), F.pmod(F.col("user_id") * 7 + F.col("event_id"), F.lit(1000)).cast("string"))
    amt = F.format_string("%.7f", F.col("value"))
    half = F.format_string("%.7f", F.col("value") / 2)
    credit = F.col("event_type") != "view"
    asset = _asset_col()
    code, issuer = F.split(asset, ":").getItem(0), F.split(asset, ":").getItem(1)
    is_pay, is_create, is_merge = typ == "payment", typ == "create_account", typ == "account_merge"
    is_path, is_trust = typ == "path_payment_strict_send", typ == "change_trust"
    has_asset = is_pay | is_path | is_trust
    plen = F.pmod(F.floor(F.col("event_id") / 5), F.lit(3)).cast("int")
    path = F.when(plen > 0, F.transform(F.sequence(F.lit(0), plen - 1), lambda i: F.struct(
        F.lit("credit_alphanum4").alias("asset_type"), F.concat(F.lit("P"), i.cast("string")).alias("asset_code"),
        F.lit("GP").alias("asset_issuer")))).otherwise(F.array().cast(
            "array<struct<asset_type:string,asset_code:string,asset_issuer:string>>"))
    rec = F.struct(
        F.col("event_id").cast("string").alias("id"),
        F.col("event_id").cast("string").alias("paging_token"),
        typ.alias("type"), k.alias("type_i"), src.alias("source_account"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        F.lower(F.lpad(F.hex(F.floor(F.col("event_id") / 2)), 64, "0")).alias("transaction_hash"),
        (F.floor(F.col("event_id") / 10) + 1).alias("ledger"),
        F.when(is_pay | is_path, dst).alias("to"),
        F.when(is_pay | is_path, src).alias("from"),
        F.when(is_pay, amt).when(is_path, half).alias("amount"),
        F.when(has_asset, F.when(credit, F.lit("credit_alphanum4")).otherwise(F.lit("native"))).alias("asset_type"),
        F.when(has_asset & credit, code).alias("asset_code"),
        F.when(has_asset & credit, issuer).alias("asset_issuer"),
        F.when(is_create, dst).alias("account"),
        F.when(is_create, src).alias("funder"),
        F.when(is_create, amt).alias("starting_balance"),
        F.when(is_merge, dst).alias("into"),
        F.when(is_path, amt).alias("source_amount"),
        F.when(is_path, half).alias("destination_amount"),
        F.when(is_path, F.lit("native")).alias("source_asset_type"),
        F.when(is_path, path).alias("path"),
        F.when(is_trust, src).alias("trustor"))
    return ev.select(F.col("event_id").alias("seq"), F.to_json(rec).alias("raw"))


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> raw transaction records for the quality checks (all text, like parsed JSON).

    seq = 2*event_id (ingest order); id 'tx_<event_id>', null when event_id mod 17 = 0;
    source_account null when event_id mod 23 = 0; amount text 'not_a_float' for every third
    error event; rows with event_id mod 10 = 0 arrive twice (second copy seq + 1)."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    base = ev.select(
        "event_id", (F.col("event_id") * 2).alias("seq"),
        F.when(F.pmod("event_id", F.lit(17)) == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("tx_"), F.col("event_id").cast("string"))).alias("id"),
        F.when(F.pmod("event_id", F.lit(23)) == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("G"), F.col("user_id").cast("string"))).alias("source_account"),
        F.when((F.col("event_type") == "error") & (F.pmod("event_id", F.lit(3)) == 0), F.lit("not_a_float"))
         .otherwise(F.format_string("%.2f", F.col("value"))).alias("amount"),
        F.col("props").alias("payload"), epoch_seconds("ts").cast("string").alias("timestamp"))
    dup = base.where(F.pmod("event_id", F.lit(10)) == 0).withColumn("seq", F.col("seq") + 1)
    return base.unionByName(dup).drop("event_id")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events of type error -> fraud reports (account_id, validator, confidence, seq)."""
    ev = read_table(spark, sf_dir, "events").where(F.col("event_type") == "error")
    return ev.select(F.col("user_id").alias("account_id"),
                     F.concat(F.lit("V"), F.pmod("event_id", F.lit(23)).cast("string")).alias("validator"),
                     F.pmod("event_id", F.lit(101)).cast("int").alias("confidence"),
                     F.col("event_id").alias("seq"), epoch_seconds("ts").alias("ts"))


def validators(spark: SparkSession) -> DataFrame:
    """Registered validators V0..V19: reputation (37 v) mod 101, inactive when v mod 7 = 0."""
    return spark.range(20).select(F.concat(F.lit("V"), F.col("id").cast("string")).alias("validator"),
                                  F.pmod(F.col("id") * 37, F.lit(101)).cast("int").alias("reputation"),
                                  (F.pmod("id", F.lit(7)) != 0).alias("is_active"))


# ---------------------------------------------------------------- DuckDB twins (oracle side)

def _sql_asset_case(col: str = "event_type") -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_ASSETS.items())
    return f"CASE {col} {whens} END"


SQL_ACCT_EDGES = f"""acct_edges AS (
  SELECT src, dst, amount, ts, asset, edge_id FROM (
    SELECT CAST(user_id AS VARCHAR) AS src,
           CAST(lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS VARCHAR) AS dst,
           value AS amount,
           CAST(epoch_us(ts) // 1000000 AS BIGINT) AS ts,
           {_sql_asset_case()} AS asset,
           event_id AS edge_id
    FROM events) e
  WHERE dst IS NOT NULL AND src <> dst)"""

SQL_TRADE_EDGES = """trade_edges AS (
  SELECT 'c' || CAST(o_custkey AS VARCHAR) AS src,
         's' || CAST(l_suppkey AS VARCHAR) AS dst,
         l_extendedprice AS amount,
         CAST(epoch_us(o_orderdate) // 1000000 AS BIGINT) AS ts,
         o_orderpriority AS asset,
         l_orderkey * 8 + l_linenumber AS edge_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

SQL_SCORED = """scored AS (
  SELECT id, account, ts, y_true, y_prob, CAST(y_prob >= 0.5 AS INTEGER) AS y_pred FROM (
    SELECT event_id AS id, user_id AS account, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS ts,
           CAST(event_type = 'error' AS INTEGER) AS y_true,
           0.7 * (((event_id * 7919) % 1000) / 1000.0) + 0.3 * CAST(event_type = 'error' AS INTEGER) AS y_prob
    FROM events) s)"""

# expected normalised fields of each raw operation, computed straight from events
SQL_OPS_EXPECTED = f"""ops_x AS (
  SELECT event_id AS seq, event_id AS operation_id, ts AS ts_raw,
    CAST(epoch_us(ts) // 1000000 AS BIGINT) AS ts,
    ['payment', 'create_account', 'account_merge', 'path_payment_strict_send', 'change_trust'][(event_id % 5) + 1] AS type,
    'G' || CAST(user_id AS VARCHAR) AS sender,
    'G' || CAST((user_id * 7 + event_id) % 1000 AS VARCHAR) AS cp,
    lower(lpad(hex(event_id // 2), 64, '0')) AS transaction_hash,
    event_id // 10 + 1 AS ledger_sequence,
    value, value / 2 AS half, CAST((event_id // 5) % 3 AS BIGINT) AS plen,
    CASE WHEN event_type = 'view' THEN 'XLM' ELSE {_sql_asset_case()} END AS ev_asset
  FROM events)"""

SQL_TXN = """txn AS (
  SELECT event_id * 2 AS seq, CASE WHEN event_id % 17 = 0 THEN NULL ELSE 'tx_' || CAST(event_id AS VARCHAR) END AS id,
    CASE WHEN event_id % 23 = 0 THEN NULL ELSE 'G' || CAST(user_id AS VARCHAR) END AS source_account,
    CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'not_a_float' ELSE printf('%.2f', value) END AS amount,
    props AS payload, CAST(epoch_us(ts) // 1000000 AS VARCHAR) AS "timestamp", event_id FROM events),
txn2 AS (SELECT seq, id, source_account, amount, payload, "timestamp" FROM txn
  UNION ALL SELECT seq + 1, id, source_account, amount, payload, "timestamp" FROM txn WHERE event_id % 10 = 0)"""

SQL_REPORTS = """reports AS (SELECT user_id AS account_id, 'V' || CAST(event_id % 23 AS VARCHAR) AS validator,
    CAST(event_id % 101 AS INTEGER) AS confidence, event_id AS seq FROM events WHERE event_type = 'error'),
validators AS (SELECT 'V' || CAST(i AS VARCHAR) AS validator, CAST((i * 37) % 101 AS INTEGER) AS reputation,
    i % 7 <> 0 AS is_active FROM range(20) t(i))"""

SQL_ACCT_EDGES_ALL = SQL_ACCT_EDGES.replace("acct_edges AS (", "acct_edges_all AS (").replace(
    "WHERE dst IS NOT NULL AND src <> dst)", ")")

SQL_VIEWS = {"acct_edges": SQL_ACCT_EDGES, "trade_edges": SQL_TRADE_EDGES,
             "acct_edges_all": SQL_ACCT_EDGES_ALL, "scored": SQL_SCORED,
             "ops_x": SQL_OPS_EXPECTED, "txn": SQL_TXN, "reports": SQL_REPORTS}


def with_views(sql_body: str, *views: str, extra: list[str] | None = None) -> str:
    """Prefix a query with the CTEs of the named adapter views (and extra CTE texts)."""
    ctes = [SQL_VIEWS[v] for v in views] + list(extra or [])
    if not ctes:
        return sql_body
    body = sql_body.lstrip()
    if body[:5].upper() == "WITH ":   # merge the body's own CTE list into ours
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + sql_body


EDGE_SOURCES = {"acct": acct_edges, "trade": trade_edges}
