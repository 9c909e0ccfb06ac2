"""Registered queries: transaction parsing and joins, account timeline, single-account
frequency, first-seen override, per-split node index, encodings and augmentation."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import sql_draw60
from ..operators import edges as ed
from ..operators import encoding as enc
from ..operators import features as feat
from ..operators import ingest as ig
from ..operators.temporal import minmax_normalize
from ..sources.adapters import acct_edges, raw_ops, trade_edges, with_views
from ..sources.tables import read_table
from .registry import register


def _tx_json(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    g = ev.groupBy(F.floor(F.col("event_id") / 2).alias("tx")).agg(
        F.min("ts").alias("t"), F.count(F.lit(1)).alias("n"), F.min_by("user_id", "event_id").alias("src"),
        F.sum((F.col("event_type") == "error").cast("int")).alias("errs"), F.min("event_id").alias("e0"))
    rec = F.struct(F.lower(F.lpad(F.hex("tx"), 64, "0")).alias("hash"), (F.floor(F.col("e0") / 10) + 1).cast("string").alias("ledger"),
                   F.concat(F.lit("G"), F.col("src").cast("string")).alias("source_account"),
                   F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
                   (F.col("n") * 100).cast("string").alias("fee_charged"), F.col("n").cast("string").alias("operation_count"),
                   F.when(F.col("errs") == 0, "true").otherwise("false").alias("successful"),
                   F.lit("text").alias("memo_type"), F.concat(F.lit("m"), F.col("tx").cast("string")).alias("memo"))
    return g.select(F.to_json(rec).alias("raw"))


_TX_SQL = """txp AS (SELECT lower(lpad(hex(event_id // 2), 64, '0')) AS hash, CAST(MIN(event_id) // 10 + 1 AS BIGINT) AS ledger_sequence,
  'G' || CAST(arg_min(user_id, event_id) AS VARCHAR) AS source_account, CAST(COUNT(*) * 100 AS BIGINT) AS fee,
  CAST(COUNT(*) AS BIGINT) AS operation_count, SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) = 0 AS successful,
  CAST(epoch_us(MIN(ts)) // 1000000 AS BIGINT) AS created_ts FROM events GROUP BY event_id // 2)"""


@register("parse_transactions", operators="A5 X6 (ledger -> ledger_sequence, fee_charged -> fee)",
          sql=with_views("SELECT * FROM txp", extra=[_TX_SQL]))
def q_parse_tx(spark, sf_dir):
    t = ig.parse_transactions(_tx_json(spark, sf_dir))
    return t.select("hash", "ledger_sequence", "source_account", F.col("fee").cast("long").alias("fee"),
                    F.col("operation_count").cast("long").alias("operation_count"), "successful",
                    F.unix_timestamp("created_at").alias("created_ts"))


@register("operations_by_ledger_range", operators="F1 J1 (operations joined to transactions, ledger range, account list)",
          sql=with_views("""SELECT o.operation_id AS id, o.type, o.sender AS source_account,
  CASE WHEN o.type = 'change_trust' THEN NULL ELSE o.cp END AS destination_account, t.ledger_sequence, t.successful
FROM ops_x o JOIN txp t ON t.hash = o.transaction_hash
WHERE t.ledger_sequence BETWEEN 50 AND 400
  AND (o.sender IN ('G1', 'G2', 'G3') OR (CASE WHEN o.type = 'change_trust' THEN NULL ELSE o.cp END) IN ('G1', 'G2', 'G3'))""",
                         "ops_x", extra=[_TX_SQL]))
def q_ops_range(spark, sf_dir):
    ops = ig.parse_operations(raw_ops(spark, sf_dir))
    tx = ig.parse_transactions(_tx_json(spark, sf_dir))
    j = ops.join(tx.select(F.col("hash").alias("transaction_hash"), "ledger_sequence", "successful"), "transaction_hash")
    acc = ["G1", "G2", "G3"]
    return j.where(F.col("ledger_sequence").between(50, 400)
                   & (F.col("source_account").isin(acc) | F.col("destination_account").isin(acc))) \
        .select("id", "type", "source_account", "destination_account", "ledger_sequence", "successful")


@register("account_timeline", operators="F7 (inbound / outbound activity of one account in a window, latest)",
          sql=with_views("""SELECT direction, asset, CAST(COUNT(*) AS BIGINT) AS n, MAX(ts) AS latest_ts,
  arg_max(edge_id, (ts, edge_id)) AS latest_edge FROM (
  SELECT 'outbound' AS direction, * FROM acct_edges WHERE src = '7' UNION ALL SELECT 'inbound', * FROM acct_edges WHERE dst = '7') x
WHERE ts BETWEEN 1704067200 AND 1705276799 GROUP BY direction, asset""", "acct_edges"))
def q_timeline(spark, sf_dir):
    e = acct_edges(spark, sf_dir).where(F.col("ts").between(1704067200, 1705276799))
    x = e.where(F.col("src") == "7").withColumn("direction", F.lit("outbound")).unionByName(
        e.where(F.col("dst") == "7").withColumn("direction", F.lit("inbound")))
    return x.groupBy("direction", "asset").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("latest_ts"),
                                               F.max_by("edge_id", F.struct("ts", "edge_id")).alias("latest_edge"))


@register("account_timeline_replay", operators="F7 (activity of one account in a window, by asset, in replay order)",
          sql=with_views("""SELECT CAST(ROW_NUMBER() OVER (ORDER BY ts, edge_id) - 1 AS BIGINT) AS replay, edge_id, ts, asset, amount,
  CASE WHEN src = '7' THEN 'outbound' ELSE 'inbound' END AS direction FROM acct_edges
WHERE (src = '7' OR dst = '7') AND ts BETWEEN 1704067200 AND 1705276799 AND asset IN (SELECT DISTINCT asset FROM acct_edges WHERE asset <> 'XLM')""",
                         "acct_edges"), doubles=["amount"])
def q_timeline_replay(spark, sf_dir):
    e = acct_edges(spark, sf_dir)
    t = ed.account_timeline(e.where(F.col("asset") != "XLM"), "7", since=1704067200, until=1705276799)
    return t.select("replay", "edge_id", "ts", "asset", "amount", "direction")


@register("account_frequency", operators="G2 (daily frequency of one account)",
          sql="""WITH d AS (SELECT CAST(ts AS DATE) AS day, COUNT(*) AS c FROM events WHERE user_id = 7 GROUP BY 1),
cal AS (SELECT UNNEST(generate_series((SELECT MIN(day) FROM d), (SELECT MAX(day) FROM d), INTERVAL 1 DAY)) AS day),
z AS (SELECT COALESCE(d.c, 0) AS c FROM cal LEFT JOIN d ON CAST(cal.day AS DATE) = d.day)
SELECT CAST(7 AS BIGINT) AS account, AVG(c) AS mean_tx_per_day, CASE WHEN COUNT(*) > 1 THEN STDDEV_SAMP(c) ELSE 0.0 END AS std_tx_per_day,
  CASE WHEN AVG(c) + STDDEV_SAMP(c) = 0 THEN 0.0 ELSE (STDDEV_SAMP(c) - AVG(c)) / (STDDEV_SAMP(c) + AVG(c)) END AS burstiness FROM z""",
          doubles=["mean_tx_per_day", "std_tx_per_day", "burstiness"])
def q_account_freq(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("account"), F.col("ts").alias("timestamp"))
    return feat.account_frequency(ev, 7)


@register("first_seen_override", operators="J5 (given first-seen overrides observed; dictionary-only nodes added)",
          sql=with_views("""WITH ep AS (SELECT src AS node, 1 AS is_out, amount, CAST(ts AS DOUBLE) AS ts FROM acct_edges
    UNION ALL SELECT dst, 0, amount, CAST(ts AS DOUBLE) FROM acct_edges),
b AS (SELECT node, CAST(SUM(1 - is_out) AS BIGINT) AS in_degree, CAST(SUM(is_out) AS BIGINT) AS out_degree, MIN(ts) AS fs FROM ep GROUP BY node),
fsd AS (SELECT CAST(c_custkey AS VARCHAR) AS node, 1704067200.0 + c_custkey * 600.0 AS first_seen FROM customer)
SELECT COALESCE(b.node, fsd.node) AS node, COALESCE(b.in_degree, 0) AS in_degree, COALESCE(b.out_degree, 0) AS out_degree,
  COALESCE(fsd.first_seen, b.fs) AS first_seen,
  GREATEST((SELECT MAX(ts) FROM acct_edges) - COALESCE(fsd.first_seen, b.fs), 0.0) AS account_age
FROM b FULL OUTER JOIN fsd ON b.node = fsd.node""", "acct_edges"), doubles=["first_seen", "account_age"])
def q_first_seen(spark, sf_dir):
    fs = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("node"),
                                                       (F.lit(1704067200.0) + F.col("c_custkey") * 600.0).alias("first_seen"))
    f = feat.node_features(acct_edges(spark, sf_dir), fs)
    return f.select("node", "in_degree", "out_degree", "first_seen", "account_age")


@register("split_node_index", operators="W12 (position of each account in a split's sorted account list)",
          sql=with_views("""WITH e AS (SELECT src, dst, ts // 3600 AS t FROM acct_edges),
l AS (SELECT t, DENSE_RANK() OVER (ORDER BY t) AS r FROM (SELECT DISTINCT t FROM e) d),
er AS (SELECT e.*, l.r FROM e JOIN l ON e.t = l.t),
m AS (SELECT b.t AS b, er.src, er.dst FROM l b JOIN er ON er.r < b.r AND er.r >= b.r - 10
      UNION ALL SELECT b.t, e.src, e.dst FROM l b JOIN e ON e.t >= b.t AND e.t < b.t + 5),
n AS (SELECT DISTINCT b, a FROM (SELECT b, src AS a FROM m UNION ALL SELECT b, dst FROM m) x)
SELECT CAST(b AS BIGINT) AS boundary, a AS node, CAST(ROW_NUMBER() OVER (PARTITION BY b ORDER BY a) - 1 AS BIGINT) AS idx FROM n""",
                         "acct_edges"))
def q_split_index(spark, sf_dir):
    from ..plans.ordering import with_global_rank
    e = acct_edges(spark, sf_dir).select(F.floor(F.col("ts") / 3600).cast("long").alias("t"), "src", "dst")
    led = e.select("t").distinct()
    rk = with_global_rank(led, ["t"], "r")
    er = e.join(rk, "t")
    ctx = er.select("src", "dst", F.explode(F.sequence(F.col("r") + 1, F.col("r") + 10)).alias("rb")) \
        .join(rk.select(F.col("r").alias("rb"), F.col("t").alias("b")), "rb").drop("rb")
    fut = e.select("src", "dst", F.explode(F.sequence(F.col("t") - 4, F.col("t"))).alias("b")) \
        .join(led.select(F.col("t").alias("b")), "b", "left_semi")
    nodes = ctx.unionByName(fut).select("b", F.explode(F.array("src", "dst")).alias("node")).distinct()
    from ..operators.sampling import rank_within
    r = rank_within(nodes, ["b"], ["node"], "idx")
    return r.select(F.col("b").alias("boundary"), "node", F.col("idx").cast("long").alias("idx"))


@register("asset_sparse_one_hot", operators="X8 (sparse vector: size, indices, values)",
          sql=with_views("""WITH v AS (SELECT asset, DENSE_RANK() OVER (ORDER BY asset) - 1 AS idx FROM (SELECT DISTINCT asset FROM trade_edges) d)
SELECT e.edge_id, CAST(v.idx AS BIGINT) AS index, CAST((SELECT COUNT(*) FROM v) AS BIGINT) AS size, CAST(1 AS BIGINT) AS entries
FROM trade_edges e JOIN v ON v.asset = e.asset""", "trade_edges"))
def q_sparse_one_hot(spark, sf_dir):
    e = trade_edges(spark, sf_dir).select("edge_id", "asset")
    x = enc.sparse_one_hot(e, enc.asset_vocabulary(e))
    return x.select("edge_id", F.col("one_hot.indices")[0].alias("index"), "one_hot.size",
                    F.size("one_hot.values").alias("entries"))


@register("asset_one_hot", operators="X8 (sorted vocabulary, unknown -> index 0, one-hot)",
          sql=with_views("""WITH v AS (SELECT asset, DENSE_RANK() OVER (ORDER BY asset) - 1 AS idx FROM (SELECT DISTINCT asset FROM acct_edges) d)
SELECT e.asset, CAST(COALESCE(v.idx, 0) AS BIGINT) AS index, CAST(COUNT(*) AS BIGINT) AS n, CAST((SELECT COUNT(*) FROM v) AS BIGINT) AS width
FROM acct_edges e LEFT JOIN v ON v.asset = e.asset GROUP BY 1, 2""", "acct_edges"))
def q_one_hot(spark, sf_dir):
    e = acct_edges(spark, sf_dir)
    oh = enc.one_hot_assets(e, enc.asset_vocabulary(e))
    return oh.groupBy("asset", "index").agg(F.count(F.lit(1)).alias("n"), F.first(F.size("one_hot")).cast("long").alias("width"))


@register("asset_embedding_lookup", operators="X9 (asset index -> given embedding table)",
          sql=with_views("""WITH v AS (SELECT asset, DENSE_RANK() OVER (ORDER BY asset) - 1 AS idx FROM (SELECT DISTINCT asset FROM acct_edges) d)
SELECT v.asset, CAST(v.idx AS BIGINT) AS index, CAST(m.embedding[1] AS DOUBLE) AS e0,
  SQRT(list_dot_product(CAST(m.embedding AS DOUBLE[]), CAST(m.embedding AS DOUBLE[]))) AS norm
FROM v LEFT JOIN embeddings m ON m.vec_id = v.idx""", "acct_edges"), doubles=["e0", "norm"])
def q_embedding_lookup(spark, sf_dir):
    e = acct_edges(spark, sf_dir)
    v = enc.asset_vocabulary(e)
    j = enc.embedding_lookup(v, read_table(spark, sf_dir, "embeddings"))
    sq = F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, b: a + b)
    return j.select("asset", "index", F.col("embedding")[0].cast("double").alias("e0"), F.sqrt(sq).alias("norm"))


@register("time_encoding", operators="X10 (sinusoidal encoding of the time index)",
          sql=with_views("""SELECT edge_id, CAST(idx AS BIGINT) AS idx, SIN(idx) AS s0, COS(idx) AS c0, SIN(idx / POW(10000.0, 2.0 * 3 / 16)) AS s3
FROM (SELECT edge_id, CAST(FLOOR((ts - (SELECT MIN(ts) FROM acct_edges)) * 1.0 / 2592000.0 * 16) AS BIGINT) % 16 AS idx FROM acct_edges) x""",
                         "acct_edges"), doubles=["s0", "c0", "s3"])
def q_time_encoding(spark, sf_dir):
    e = acct_edges(spark, sf_dir)
    mn = e.agg(F.min("ts").alias("_mn"))
    x = e.crossJoin(F.broadcast(mn)).withColumn("t", (F.col("ts") - F.col("_mn")).cast("double"))
    t = enc.encode_time(x, "t", 2592000.0, 16)
    idx = F.pmod(F.floor(F.col("t") / 2592000.0 * 16), F.lit(16))
    return t.select("edge_id", idx.cast("long").alias("idx"), F.col("time_encoding")[0].alias("s0"),
                    F.col("time_encoding")[1].alias("c0"), F.col("time_encoding")[6].alias("s3"))


@register("edge_type_features", operators="X11 (amount + stable hash of the operation type)",
          sql=with_views(f"""SELECT type, ({sql_draw60('type')} % 1000) / 1000.0 AS type_feature, CAST(COUNT(*) AS BIGINT) AS n
FROM ops_x GROUP BY 1, 2""", "ops_x"), doubles=["type_feature"])
def q_edge_feats(spark, sf_dir):
    flat = ig.parse_json(raw_ops(spark, sf_dir), ig.OPERATION_SCHEMA, keep=("seq",)).select("seq", "r.*")
    n = ig.normalize_backfill(flat, "seq")
    return enc.edge_features(n).groupBy("type", "type_feature").agg(F.count(F.lit(1)).alias("n"))


@register("temporal_augmentation", operators="X12 (time noise, age-weighted dropout, scaling)",
          sql=with_views(f"""SELECT CAST(COUNT(*) AS BIGINT) AS kept, MIN(noisy) AS min_t, MAX(noisy) AS max_t, MAX(scaled) AS max_scaled FROM (
  SELECT LEAST(GREATEST(t + 0.01 * SQRT(-2 * LN((({sql_draw60('edge_id', '0', '1')} % {1 << 30}) + 1) / {float((1 << 30) + 1)!r}))
      * COS(2 * PI() * (({sql_draw60('edge_id', '0', '2')} % {1 << 30}) / {float(1 << 30)!r})), 0.0), 1.0) AS noisy,
    LEAST(GREATEST(t * (0.8 + (1.2 - 0.8) * (({sql_draw60('0', '0', '9')} % {1 << 40}) / {float(1 << 40)!r})), 0.0), 1.0) AS scaled,
    ({sql_draw60('edge_id', '0', '3')} % {1 << 40}) / {float(1 << 40)!r} >= 0.1 * (1.0 - t) AS keep
  FROM (SELECT edge_id, (ts - MIN(ts) OVER ()) / CAST(MAX(ts) OVER () - MIN(ts) OVER () AS DOUBLE) AS t FROM acct_edges) n) a WHERE keep""",
                         "acct_edges"), doubles=["min_t", "max_t", "max_scaled"])
def q_augment(spark, sf_dir):
    e = minmax_normalize(acct_edges(spark, sf_dir), "ts", "t")
    a = enc.augment(e, "t", "edge_id")
    return a.agg(F.count(F.lit(1)).alias("kept"), F.min("t_noisy").alias("min_t"), F.max("t_noisy").alias("max_t"),
                 F.max("t_scaled").alias("max_scaled"))
