"""Registered queries: fraud injection and alerts, loyalty views, privacy, documented operators."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import sql_draw60
from ..operators import documented as dc
from ..operators import fraud as fr
from ..operators import ingest as ig
from ..operators import privacy as pv
from ..operators import quality as qa
from ..sources.adapters import acct_edges, raw_ops, reports, scored, txn, with_views
from ..session import cut_lineage
from ..sources.tables import read_table
from .registry import register

# ----------------------------------------------------------------------------- fraud / loyalty


@register("fraud_injection", operators="A15 G15 S2 (sybil + wash rows appended, labelled, timed after the data)",
          sql=with_views("""SELECT 'original' AS pattern, CAST(COUNT(*) AS BIGINT) AS n, MIN(ts) AS min_ts, MAX(ts) AS max_ts, true AS amounts_ok FROM acct_edges
UNION ALL SELECT 'sybil_cluster', 30, (SELECT MAX(ts) FROM acct_edges) + 1, (SELECT MAX(ts) FROM acct_edges) + 30, true
UNION ALL SELECT 'wash_trading_loop', 40, (SELECT MAX(ts) FROM acct_edges) + 31, (SELECT MAX(ts) FROM acct_edges) + 70, true""", "acct_edges"))
def q_injection(spark, sf_dir):
    aug = fr.inject_fraud(acct_edges(spark, sf_dir))
    base = F.when(F.col("fraud_pattern") == "sybil_cluster", F.lit(fr.SYBIL["base_amount"])) \
        .when(F.col("fraud_pattern") == "wash_trading_loop", F.lit(fr.WASH["base_amount"]))
    spread = F.when(F.col("fraud_pattern") == "sybil_cluster", F.lit(fr.SYBIL["spread"])).otherwise(F.lit(fr.WASH["spread"]))
    ok = F.when(base.isNull(), F.lit(True)).otherwise(
        (F.col("amount") >= base * (1 - spread) - 1e-7) & (F.col("amount") <= base * (1 + spread) + 1e-7))
    return aug.groupBy(F.coalesce("fraud_pattern", F.lit("original")).alias("pattern")).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"),
        F.bool_and(ok).alias("amounts_ok"))


_ALERTS_SQL = """alerts AS (SELECT seq, ts, confidence AS risk_score,
  ['sybil_cluster', 'wash_trading_loop', 'anomaly'][(seq % 3) + 1] AS pattern FROM reports_t)"""
_REPORTS_T_SQL = """reports_t AS (SELECT event_id AS seq, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS ts,
  CAST(event_id % 101 AS INTEGER) AS confidence FROM events WHERE event_type = 'error')"""


def _alerts(spark, sf_dir):
    r = reports(spark, sf_dir)
    pat = F.element_at(F.array(F.lit("sybil_cluster"), F.lit("wash_trading_loop"), F.lit("anomaly")),
                       (F.pmod("seq", F.lit(3)) + 1).cast("int"))
    return r.select("seq", "ts", F.col("confidence").alias("risk_score"), pat.alias("pattern"))


@register("risk_alerts", operators="G16 (alerts by risk band and pattern)",
          sql=with_views("""SELECT CASE WHEN risk_score >= 75 THEN 'high' WHEN risk_score >= 50 THEN 'medium' ELSE 'low' END AS band,
  pattern, CAST(COUNT(*) AS BIGINT) AS alerts, AVG(risk_score) AS mean_score FROM alerts GROUP BY 1, 2""",
                         extra=[_REPORTS_T_SQL, _ALERTS_SQL]), doubles=["mean_score"])
def q_risk_alerts(spark, sf_dir):
    return fr.alert_summary(_alerts(spark, sf_dir))


@register("risk_over_time", operators="G16 (mean risk score per day)",
          sql=with_views("""SELECT CAST(CAST(DATE '1970-01-01' + CAST(ts // 86400 AS INTEGER) AS DATE) AS VARCHAR) AS day, AVG(risk_score) AS score
FROM alerts GROUP BY 1""", extra=[_REPORTS_T_SQL, _ALERTS_SQL]), doubles=["score"])
def q_risk_time(spark, sf_dir):
    return fr.risk_over_time(_alerts(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


_POINTS_SQL = """pts AS (SELECT user_id AS account, event_id AS id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS ts,
  CAST(CASE WHEN event_type = 'purchase' THEN FLOOR(value) ELSE -FLOOR(value / 2) END AS BIGINT) AS points
  FROM events WHERE event_type IN ('purchase', 'error'))"""


def _points(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "error"))
    from ..sources.adapters import epoch_seconds
    return ev.select(F.col("user_id").alias("account"), F.col("event_id").alias("id"), epoch_seconds("ts").alias("ts"),
                     F.when(F.col("event_type") == "purchase", F.floor("value"))
                     .otherwise(-F.floor(F.col("value") / 2)).cast("long").alias("points"))


@register("points_ledger", operators="G17 (running balance per account, redemption validity)",
          sql=with_views("""SELECT account, id, points, CAST(bb AS BIGINT) AS balance_before,
  CASE WHEN points < 0 THEN (-points > 0 AND -points <= bb) ELSE true END AS valid FROM (
  SELECT *, SUM(points) OVER (PARTITION BY account ORDER BY ts, id) - points AS bb FROM pts) x""", extra=[_POINTS_SQL]))
def q_points(spark, sf_dir):
    return fr.points_ledger(_points(spark, sf_dir)).select("account", "id", "points", "balance_before", "valid")


@register("tier_lookup", operators="J11 (highest tier threshold <= balance, next tier, progress)",
          sql=with_views("""SELECT account, balance,
  CASE WHEN balance >= 6000 THEN 'platinum' WHEN balance >= 3000 THEN 'gold' WHEN balance >= 1500 THEN 'silver' END AS tier,
  CASE WHEN balance < 1500 THEN 'silver' WHEN balance < 3000 THEN 'gold' WHEN balance < 6000 THEN 'platinum' END AS next_tier,
  CAST(CASE WHEN balance < 1500 THEN 1500 WHEN balance < 3000 THEN 3000 WHEN balance < 6000 THEN 6000 END AS DOUBLE) AS next_threshold,
  CAST(CASE WHEN balance < 1500 THEN 1500 - balance WHEN balance < 3000 THEN 3000 - balance WHEN balance < 6000 THEN 6000 - balance END AS DOUBLE) AS remaining_to_upgrade,
  LEAST(100.0, FLOOR(CAST(balance AS DOUBLE) / CASE WHEN balance < 1500 THEN 1500 WHEN balance < 3000 THEN 3000 WHEN balance < 6000 THEN 6000 END * 100 + 0.5)) AS progress_pct
FROM (SELECT account, CAST(SUM(points) * 10 AS BIGINT) AS balance FROM pts GROUP BY account) b""", extra=[_POINTS_SQL]),
          doubles=["progress_pct", "next_threshold", "remaining_to_upgrade"])
def q_tiers(spark, sf_dir):
    b = _points(spark, sf_dir).groupBy("account").agg((F.sum("points") * 10).cast("long").alias("balance"))
    # thresholds are null above the top tier: doubles keep the column type stable in every client
    return fr.tier_lookup(b).withColumn("next_threshold", F.col("next_threshold").cast("double")) \
        .withColumn("remaining_to_upgrade", F.col("remaining_to_upgrade").cast("double"))


@register("history_page", operators="T3 (page 2 of 20 rows, newest first, with total)",
          sql=with_views("""SELECT p.*, t.total FROM (SELECT account, id, ts, points FROM pts WHERE account = 7
  ORDER BY ts DESC, id DESC LIMIT 20 OFFSET 20) p CROSS JOIN (SELECT CAST(COUNT(*) AS BIGINT) AS total FROM pts WHERE account = 7) t""",
                         extra=[_POINTS_SQL]))
def q_history(spark, sf_dir):
    page, total = fr.history_page(_points(spark, sf_dir), 7, 1, 20)
    return page.select("account", "id", "ts", "points").crossJoin(total)


@register("pool_concentration", operators="G20 (top-3 holders' share per asset pool)",
          sql=with_views("""WITH h AS (SELECT asset, account, SUM(a) AS balance FROM (
    SELECT asset, dst AS account, CAST(amount AS DECIMAL(38,7)) AS a FROM acct_edges
    UNION ALL SELECT asset, src, -CAST(amount AS DECIMAL(38,7)) FROM acct_edges) x GROUP BY asset, account),
p AS (SELECT * FROM h WHERE balance > 0),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY asset ORDER BY balance DESC, account) AS rn FROM p)
SELECT asset, CAST(SUM(CASE WHEN rn <= 3 THEN balance ELSE 0 END) AS DOUBLE) / CAST(SUM(balance) AS DOUBLE) AS top_share
FROM r GROUP BY asset""", "acct_edges"), doubles=["top_share"])
def q_pools(spark, sf_dir):
    e = acct_edges(spark, sf_dir)
    a = F.col("amount").cast("decimal(38,7)")
    h = e.select("asset", F.col("dst").alias("account"), a.alias("a")).unionByName(
        e.select("asset", F.col("src").alias("account"), (-a).alias("a")))
    hold = h.groupBy("asset", "account").agg(F.sum("a").alias("balance"))
    out = fr.pool_concentration(hold)
    return out.withColumn("top_share", F.col("top_share").cast("double"))


@register("lp_velocity", operators="G21 (creations / withdrawals per day)",
          sql=with_views("""SELECT CAST((ts // 86400) * 86400 AS BIGINT) AS window_start,
  CAST(SUM(CASE WHEN type = 'create_account' THEN 1 ELSE 0 END) AS BIGINT) AS creations,
  CAST(SUM(CASE WHEN type = 'account_merge' THEN 1 ELSE 0 END) AS BIGINT) AS withdrawals FROM ops_x GROUP BY 1""", "ops_x"))
def q_lp_velocity(spark, sf_dir):
    flat = ig.parse_json(raw_ops(spark, sf_dir), ig.OPERATION_SCHEMA, keep=("seq",)).select("seq", "r.*")
    n = ig.normalize_backfill(flat, "seq").withColumn("ts", F.unix_timestamp("timestamp"))
    return fr.lp_velocity(n).withColumn("window_start", F.col("window_start").cast("long"))


@register("daily_rollup", operators="G23 (ROLLUP account, day, asset)",
          sql=with_views("""SELECT src AS account, CAST(CAST(DATE '1970-01-01' + CAST(ts // 86400 AS INTEGER) AS DATE) AS VARCHAR) AS day, asset,
  CAST(COUNT(*) AS BIGINT) AS tx_count, CAST(SUM(CAST(amount AS DECIMAL(38,7))) AS DOUBLE) AS volume,
  CAST(GROUPING(src, DATE '1970-01-01' + CAST(ts // 86400 AS INTEGER), asset) AS BIGINT) AS level
FROM acct_edges GROUP BY ROLLUP (src, DATE '1970-01-01' + CAST(ts // 86400 AS INTEGER), asset)""", "acct_edges"),
          doubles=["volume"])
def q_rollup(spark, sf_dir):
    return fr.daily_rollup(acct_edges(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


# ----------------------------------------------------------------------------- privacy

def _lap_sql(key: str, salt: int, scale: str, seed: int = 0) -> str:
    u = f"(((({key} % 2147483648) * 2654435761 + {seed * 40503 + salt * 97}) % 4294967296) + 0.5) / 4294967296.0"
    return f"(-({scale}) * SIGN({u} - 0.5) * LN(1.0 - 2.0 * ABS({u} - 0.5)))"


@register("noisy_wallet_stats", operators="P1 (Laplace-noised count, mean amount, time span per wallet)",
          sql=f"""SELECT user_id, count, mean_amount, time_span,
  count + {_lap_sql('user_id', 1, '1.0')} AS noisy_count,
  mean_amount + {_lap_sql('user_id', 2, '1000.0')} AS noisy_mean_amount,
  time_span + {_lap_sql('user_id', 3, '86400.0')} AS noisy_time_span
FROM (SELECT user_id, CAST(COUNT(*) AS BIGINT) AS count, CAST(SUM(CAST(value AS DECIMAL(38,7))) AS DOUBLE) / COUNT(*) AS mean_amount,
             CAST(MAX(epoch_us(ts) // 1000000) - MIN(epoch_us(ts) // 1000000) AS DOUBLE) AS time_span FROM events GROUP BY user_id) g""",
          doubles=["mean_amount", "time_span", "noisy_count", "noisy_mean_amount", "noisy_time_span"])
def q_noisy(spark, sf_dir):
    from ..sources.adapters import epoch_seconds
    ev = read_table(spark, sf_dir, "events").select("user_id", "value", epoch_seconds("ts").alias("ts"))
    return pv.noisy_wallet_stats(ev, "user_id", "value", "ts", epsilon=1.0)


@register("bucket_profile", operators="P2 (amount, time-of-day and counterparty-type buckets)",
          sql=with_views("""WITH deg AS (SELECT dst AS c, COUNT(*) AS d FROM acct_edges GROUP BY dst),
typ AS (SELECT c, CASE WHEN d > 2 * (SELECT AVG(d) FROM deg) THEN 'hub' ELSE 'regular' END AS counterparty_type FROM deg)
SELECT src, CASE WHEN amount < 1 THEN 'lt1' WHEN amount < 10 THEN '1-10' WHEN amount < 100 THEN '10-100'
                 WHEN amount < 1000 THEN '100-1000' WHEN amount < 10000 THEN '1000-10000' ELSE 'ge10000' END AS amount_bucket,
  lpad(CAST(((ts % 86400) // 3600) // 4 * 4 AS VARCHAR), 2, '0') || '-' || lpad(CAST(((ts % 86400) // 3600) // 4 * 4 + 4 AS VARCHAR), 2, '0') AS time_bucket,
  typ.counterparty_type, CAST(COUNT(*) AS BIGINT) AS n
FROM acct_edges e LEFT JOIN typ ON typ.c = e.dst GROUP BY ALL""", "acct_edges"))
def q_buckets(spark, sf_dir):
    return pv.bucket_profile(acct_edges(spark, sf_dir), "src", "amount", "ts", "dst")


@register("signature_uniqueness", operators="P3 (bit signatures; uniqueness from per-bit counts, no pair enumeration)",
          sql=with_views(f"""WITH b AS (SELECT DISTINCT src, {sql_draw60('dst')} % 64 AS bit FROM acct_edges),
c AS (SELECT bit, COUNT(*) AS c FROM b GROUP BY bit), n AS (SELECT COUNT(DISTINCT src) AS n FROM acct_edges),
w AS (SELECT s.src, k.bit, b.bit IS NOT NULL AS is_set FROM (SELECT DISTINCT src FROM acct_edges) s
      CROSS JOIN (SELECT UNNEST(range(64)) AS bit) k LEFT JOIN b ON b.src = s.src AND b.bit = k.bit)
SELECT w.src, SUM(CASE WHEN is_set THEN n - COALESCE(c, 0) ELSE COALESCE(c, 0) END) / ((ANY_VALUE(n) - 1) * 64.0) AS uniqueness
FROM w CROSS JOIN n LEFT JOIN c ON c.bit = w.bit GROUP BY w.src""", "acct_edges"), doubles=["uniqueness"])
def q_uniqueness(spark, sf_dir):
    e = acct_edges(spark, sf_dir)
    return pv.signature_uniqueness(pv.wallet_signatures(e, "src", "dst"), "src")


_SIGNATURE_SQL = f"""sb AS (SELECT DISTINCT src, {sql_draw60('dst')} % 64 AS bit FROM acct_edges),
sg AS (SELECT src, COUNT(*) AS n, string_agg(CAST(bit AS VARCHAR), ',' ORDER BY bit) AS signature FROM sb GROUP BY src),
sc AS (SELECT a.src AS a, b.src AS b, COUNT(*) AS common FROM sb a JOIN sb b ON a.bit = b.bit AND a.src <> b.src GROUP BY 1, 2),
sp AS (SELECT x.src AS a, y.src AS b, x.n + y.n - 2 * COALESCE(c.common, 0) AS differing
  FROM sg x JOIN sg y ON x.src <> y.src LEFT JOIN sc c ON c.a = x.src AND c.b = y.src),
srep AS (SELECT src, MIN(src) OVER (PARTITION BY signature) AS representative FROM sg)"""


@register("similar_wallets", operators="P3 (class of equal signatures, wallets at Hamming similarity >= 0.8, by masked parts)",
          sql=with_views("""SELECT r.src, r.representative, CAST(COUNT(p.b) AS BIGINT) AS n_similar
FROM srep r LEFT JOIN sp p ON p.a = r.src AND p.differing <= 12 GROUP BY 1, 2""", "acct_edges", extra=[_SIGNATURE_SQL]))
def q_similar_wallets(spark, sf_dir):
    return pv.similar_wallets(pv.wallet_signatures(acct_edges(spark, sf_dir), "src", "dst"), "src")


@register("similar_wallet_links", operators="P3 (links between classes of equal signatures)",
          sql=with_views("""SELECT p.a, p.b, CAST(p.differing AS BIGINT) AS differing FROM sp p
JOIN srep x ON x.src = p.a AND x.representative = p.a JOIN srep y ON y.src = p.b AND y.representative = p.b
WHERE p.a < p.b AND p.differing <= 12""", "acct_edges", extra=[_SIGNATURE_SQL]))
def q_similar_links(spark, sf_dir):
    sigs = pv.wallet_signatures(acct_edges(spark, sf_dir), "src", "dst")
    return pv.similar_classes(cut_lineage(pv.signature_classes(sigs, "src")))


@register("secret_shares", operators="P4 (additive shares, exact reconstruction)",
          sql=with_views("SELECT src, CAST(SUM(CAST(amount AS DECIMAL(38,7))) AS DOUBLE) AS value FROM acct_edges GROUP BY src",
                         "acct_edges"), doubles=["value"])
def q_shares(spark, sf_dir):
    e = acct_edges(spark, sf_dir)
    tot = e.groupBy("src").agg(F.sum(F.col("amount").cast("decimal(38,7)")).alias("total"))
    k = tot.withColumn("_k", F.xxhash64("src"))
    sh = pv.secret_shares(k, "_k", "total").join(k.select("_k", "src"), "_k")
    return pv.reconstruct(sh.select("src", "shares"), "src")


@register("federated_average", operators="P5 (per-party regression, n-weighted average of coefficients)",
          sql="""SELECT SUM(slope * n) / SUM(n) AS slope, SUM(intercept * n) / SUM(n) AS intercept, CAST(COUNT(*) AS BIGINT) AS parties
FROM (SELECT event_type, REGR_SLOPE(value, d) AS slope, REGR_INTERCEPT(value, d) AS intercept, COUNT(*) AS n FROM
      (SELECT event_type, value, CAST(epoch_us(ts) - (SELECT MIN(epoch_us(ts)) FROM events) AS DOUBLE) / 86400000000.0 AS d FROM events) x
      GROUP BY event_type) p""", doubles=["slope", "intercept"])
def q_federated(spark, sf_dir):
    from ..sources.adapters import epoch_micros
    ev = read_table(spark, sf_dir, "events").select("event_type", "value", epoch_micros("ts").alias("us"))
    mn = ev.agg(F.min("us").alias("_mn"))
    x = ev.crossJoin(F.broadcast(mn)).withColumn("d", (F.col("us") - F.col("_mn")).cast("double") / 86400000000.0)
    return pv.federated_average(x, "event_type", "d", "value")


@register("privacy_utility", operators="P6 (error of noised counts per epsilon)",
          sql=f"""SELECT eps AS epsilon, AVG(ABS({_lap_sql('user_id', 1, '1.0 / eps')})) AS mean_abs_error,
  AVG(ABS({_lap_sql('user_id', 1, '1.0 / eps')}) / cnt) AS mean_rel_error
FROM (SELECT user_id, COUNT(*) AS cnt FROM events GROUP BY user_id) c CROSS JOIN (SELECT UNNEST([0.1, 0.5, 1.0, 2.0, 5.0]) AS eps) e
GROUP BY eps""", doubles=["epsilon", "mean_abs_error", "mean_rel_error"])
def q_privacy_utility(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select("user_id")
    return pv.privacy_utility(ev, "user_id", [0.1, 0.5, 1.0, 2.0, 5.0])


# ----------------------------------------------------------------------------- documented operators

_NOW_SQL = "(SELECT MAX(ts) FROM acct_edges)"


def _now(e):
    return e.agg(F.max("ts").alias("_now"))


@register("min_activity_snapshot", operators="N1 (last 7 days, endpoints with >= 20 transactions)",
          sql=with_views(f"""WITH s AS (SELECT * FROM acct_edges WHERE ts >= GREATEST(0, {_NOW_SQL} - 7 * 86400 + 1) AND ts <= {_NOW_SQL}),
act AS (SELECT node FROM (SELECT src AS node FROM s UNION ALL SELECT dst FROM s) x GROUP BY node HAVING COUNT(*) >= 20)
SELECT src, dst, amount, ts, edge_id, 1.0 AS weight FROM s WHERE src IN (SELECT node FROM act) AND dst IN (SELECT node FROM act)""",
                         "acct_edges"), doubles=["amount", "weight"])
def q_min_activity(spark, sf_dir):
    e = acct_edges(spark, sf_dir)
    x = e.crossJoin(F.broadcast(_now(e)))
    return dc.min_activity_snapshot(x, F.col("_now"), 7, 20).select("src", "dst", "amount", "ts", "edge_id", "weight")


@register("multiscale_degrees", operators="N2 (degree over 1/7/30/90 days, growth)",
          sql=with_views(f"""SELECT node, """ + ", ".join(
              f"CAST(SUM(CASE WHEN ts > {_NOW_SQL} - {s} * 86400 AND ts <= {_NOW_SQL} THEN 1 ELSE 0 END) AS BIGINT) AS degree_{s}d"
              for s in (1, 7, 30, 90)) + """,
  (SUM(CASE WHEN ts > (SELECT MAX(ts) FROM acct_edges) - 7 * 86400 THEN 1 ELSE 0 END) - SUM(CASE WHEN ts > (SELECT MAX(ts) FROM acct_edges) - 86400 THEN 1 ELSE 0 END)) * 1.0
    / GREATEST(SUM(CASE WHEN ts > (SELECT MAX(ts) FROM acct_edges) - 86400 THEN 1 ELSE 0 END), 1) AS growth_1_7,
  (SUM(CASE WHEN ts > (SELECT MAX(ts) FROM acct_edges) - 30 * 86400 THEN 1 ELSE 0 END) - SUM(CASE WHEN ts > (SELECT MAX(ts) FROM acct_edges) - 7 * 86400 THEN 1 ELSE 0 END)) * 1.0
    / GREATEST(SUM(CASE WHEN ts > (SELECT MAX(ts) FROM acct_edges) - 7 * 86400 THEN 1 ELSE 0 END), 1) AS growth_7_30
FROM (SELECT src AS node, ts FROM acct_edges UNION ALL SELECT dst, ts FROM acct_edges) e GROUP BY node""", "acct_edges"),
          doubles=["growth_1_7", "growth_7_30"])
def q_multiscale(spark, sf_dir):
    e = acct_edges(spark, sf_dir)
    x = e.crossJoin(F.broadcast(_now(e)))
    return dc.multiscale_degrees(x, F.col("_now"))


def _clu_sql(days: int) -> str:
    return f"""a{days} AS (SELECT DISTINCT u, v FROM (SELECT src AS u, dst AS v FROM acct_edges WHERE src <> dst AND ts >= GREATEST(0, {_NOW_SQL} - {days} * 86400 + 1) AND ts <= {_NOW_SQL}
  UNION ALL SELECT dst, src FROM acct_edges WHERE src <> dst AND ts >= GREATEST(0, {_NOW_SQL} - {days} * 86400 + 1) AND ts <= {_NOW_SQL}) x),
c{days} AS (SELECT k.node, CASE WHEN k.k < 2 THEN 0.0 ELSE 2.0 * COALESCE(t.t, 0) / (k.k * (k.k - 1)) END AS clustering_{days}d
  FROM (SELECT u AS node, COUNT(*) AS k FROM a{days} GROUP BY u) k LEFT JOIN (SELECT x1.u AS node, COUNT(*) AS t FROM a{days} x1
  JOIN a{days} x2 ON x1.u = x2.u AND x1.v < x2.v JOIN a{days} x3 ON x3.u = x1.v AND x3.v = x2.v GROUP BY x1.u) t ON t.node = k.node)"""


@register("multiscale_clustering", operators="N2 (clustering over the last 1 and 7 days)",
          sql=with_views("""SELECT COALESCE(c1.node, c7.node) AS node, COALESCE(c1.clustering_1d, 0.0) AS clustering_1d,
  COALESCE(c7.clustering_7d, 0.0) AS clustering_7d FROM c1 FULL OUTER JOIN c7 ON c1.node = c7.node""", "acct_edges",
                         extra=[_clu_sql(1), _clu_sql(7)]), doubles=["clustering_1d", "clustering_7d"])
def q_multiscale_clu(spark, sf_dir):
    e = acct_edges(spark, sf_dir)
    now = e.agg(F.max("ts")).first()[0]
    return dc.multiscale_clustering(e, now)


_CW_SQL = f"""cw AS (SELECT src, dst, 0.7 * amount / MAX(amount) OVER () + 0.3 * cnt * 1.0 / MAX(cnt) OVER () + 0.2 * recency AS weight
  FROM (SELECT src, dst, CAST(SUM(CAST(amount AS DECIMAL(38,7))) AS DOUBLE) AS amount, COUNT(*) AS cnt,
               AVG(POW(0.95, GREATEST({_NOW_SQL} - ts, 0) / 86400.0)) AS recency FROM acct_edges GROUP BY src, dst) p)"""


def _cw(spark, sf_dir):
    e = acct_edges(spark, sf_dir)
    return dc.composite_edge_weight(e.crossJoin(F.broadcast(_now(e))), F.col("_now"))


@register("composite_edge_weight", operators="N3 (.7 amount + .3 frequency + .2 recency)",
          sql=with_views("SELECT src, dst, weight FROM cw", "acct_edges", extra=[_CW_SQL]), doubles=["weight"])
def q_composite(spark, sf_dir):
    return _cw(spark, sf_dir)


@register("weighted_degree_summary", operators="N4 (average weighted degree, density)",
          sql=with_views("""SELECT AVG(wd) AS avg_weighted_degree, (SELECT COUNT(*) FROM cw) * 1.0 / (COUNT(*) * (COUNT(*) - 1)) AS density
FROM (SELECT node, SUM(weight) AS wd FROM (SELECT src AS node, weight FROM cw UNION ALL SELECT dst, weight FROM cw) x GROUP BY node) n""",
                         "acct_edges", extra=[_CW_SQL]), doubles=["avg_weighted_degree", "density"])
def q_wdeg(spark, sf_dir):
    return dc.weighted_degree_summary(_cw(spark, sf_dir))


@register("top_edges", operators="N4 T1 (top-10 edges by composite weight)",
          sql=with_views("SELECT src, dst, weight FROM cw ORDER BY weight DESC, src, dst LIMIT 10", "acct_edges", extra=[_CW_SQL]),
          doubles=["weight"])
def q_top_edges(spark, sf_dir):
    return _cw(spark, sf_dir).orderBy(F.col("weight").desc(), "src", "dst").limit(10)


@register("account_profile", operators="N8 (amount statistics + frequency + gap volatility per account)",
          sql=with_views("""WITH s AS (SELECT src AS account, amount, ts, edge_id FROM acct_edges),
st AS (SELECT account, CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(CAST(amount AS DECIMAL(38,7))) AS DOUBLE) AS total,
       MIN(amount) AS min_amount, MAX(amount) AS max_amount, STDDEV_SAMP(amount) AS std_amount FROM s GROUP BY account),
d AS (SELECT account, DATE '1970-01-01' + CAST(ts // 86400 AS INTEGER) AS day, COUNT(*) AS c FROM s GROUP BY 1, 2),
dd AS (SELECT account, SUM(c) AS sc, SUM(c * c) AS qc, datediff('day', MIN(day), MAX(day)) + 1 AS nd FROM d GROUP BY account),
fq AS (SELECT account, sc * 1.0 / nd AS mean_tx_per_day,
       CASE WHEN nd > 1 THEN SQRT(GREATEST((nd * qc - sc * sc) * 1.0 / (nd * (nd - 1)), 0)) ELSE 0.0 END AS std_tx_per_day FROM dd),
g AS (SELECT account, COALESCE(AVG(gap), 0.0) AS mean_gap, COALESCE(STDDEV_SAMP(gap), 0.0) AS std_gap, COALESCE(MAX(gap), 0.0) AS max_gap
      FROM (SELECT account, CAST(ts AS DOUBLE) - LAG(CAST(ts AS DOUBLE)) OVER (PARTITION BY account ORDER BY ts, edge_id) AS gap FROM s) x GROUP BY account)
SELECT st.*, fq.mean_tx_per_day, fq.std_tx_per_day,
  CASE WHEN fq.mean_tx_per_day + fq.std_tx_per_day = 0 THEN 0.0
       ELSE (fq.std_tx_per_day - fq.mean_tx_per_day) / (fq.std_tx_per_day + fq.mean_tx_per_day) END AS burstiness,
  g.mean_gap, g.std_gap, g.max_gap
FROM st JOIN fq ON fq.account = st.account JOIN g ON g.account = st.account""", "acct_edges"),
          doubles=["total", "min_amount", "max_amount", "std_amount", "mean_tx_per_day", "std_tx_per_day", "burstiness",
                   "mean_gap", "std_gap", "max_gap"])
def q_profile(spark, sf_dir):
    return dc.account_profile(acct_edges(spark, sf_dir))


@register("normalization_filter", operators="N9 N10 (valid accounts, no test ops, minimum amount)",
          sql=with_views("""SELECT ledger_sequence, operation_id, transaction_hash, type, sender,
  CASE WHEN type = 'change_trust' THEN NULL ELSE cp END AS receiver,
  CASE type WHEN 'payment' THEN value WHEN 'create_account' THEN value WHEN 'path_payment_strict_send' THEN half ELSE NULL END AS amount
FROM ops_x WHERE COALESCE(CASE type WHEN 'payment' THEN value WHEN 'create_account' THEN value
                               WHEN 'path_payment_strict_send' THEN half ELSE NULL END, 0.0) >= 10""", "ops_x"),
          doubles=["amount"])
def q_norm_filter(spark, sf_dir):
    flat = ig.parse_json(raw_ops(spark, sf_dir), ig.OPERATION_SCHEMA, keep=("seq",)).select("seq", "r.*")
    n = ig.normalize_backfill(flat, "seq")
    return dc.normalization_filter(n, 10.0, account_pattern="^G[0-9A-Z]+$").select(
        "ledger_sequence", "operation_id", "transaction_hash", "type", "sender", "receiver", "amount")


@register("class_weights", operators="N11 (n / (classes * count))",
          sql="""SELECT CAST(label AS BIGINT) AS label, CAST(COUNT(*) AS BIGINT) AS count, (SELECT COUNT(*) FROM embeddings) * 1.0
  / ((SELECT COUNT(DISTINCT label) FROM embeddings) * COUNT(*)) AS weight FROM embeddings GROUP BY label""",
          doubles=["weight"])
def q_class_weights(spark, sf_dir):
    return dc.class_weights(read_table(spark, sf_dir, "embeddings"), "label")


@register("ensemble", operators="N12 (mean class probability over 3 models, argmax, accuracy)",
          sql="""WITH u AS (SELECT vec_id, label, i - 1 AS j, CAST(x AS DOUBLE) AS x FROM
    (SELECT vec_id, label, UNNEST(range(1, len(embedding) + 1)) AS i, UNNEST(embedding) AS x FROM embeddings) z),
m AS (SELECT u.vec_id, u.label, k.k AS model, (u.j + k.k) % 10 AS class, SUM(u.x) AS x
      FROM u CROSS JOIN (SELECT UNNEST([0, 1, 2]) AS k) k GROUP BY 1, 2, 3, 4),
m2 AS (SELECT *, EXP(x - MAX(x) OVER (PARTITION BY vec_id, model)) AS ex FROM m),
p AS (SELECT vec_id, label, model, class, ex / SUM(ex) OVER (PARTITION BY vec_id, model) AS prob FROM m2),
a AS (SELECT vec_id, label, class, AVG(prob) AS pbar FROM p GROUP BY vec_id, label, class),
b AS (SELECT vec_id, label, arg_min(class, (-pbar, class)) AS pred, MAX(pbar) AS confidence FROM a GROUP BY vec_id, label)
SELECT vec_id AS id, CAST(pred AS BIGINT) AS pred, confidence, CAST(label AS BIGINT) AS label,
  (SELECT AVG(CAST(pred = label AS DOUBLE)) FROM b) AS accuracy FROM b""",
          doubles=["confidence", "accuracy"])
def q_ensemble(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    ex = e.select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("j", "x")).withColumn("x", F.col("x").cast("double"))
    ks = spark.range(3).select(F.col("id").cast("int").alias("model"))
    # a model's logit of a class is the sum over every tenth dimension, begun at another place
    m = ex.crossJoin(F.broadcast(ks)).withColumn("class", F.pmod(F.col("j") + F.col("model"), F.lit(10)))
    m = m.groupBy("id", "model", "class").agg(F.sum("x").alias("x"))
    mx = m.groupBy("id", "model").agg(F.max("x").alias("_mx"))
    m = m.join(mx, ["id", "model"]).withColumn("_e", F.exp(F.col("x") - F.col("_mx")))
    den = m.groupBy("id", "model").agg(F.sum("_e").alias("_d"))
    probs = m.join(den, ["id", "model"]).select("id", "model", "class", (F.col("_e") / F.col("_d")).alias("prob"))
    truth = e.select(F.col("vec_id").alias("id"), "label")
    return dc.ensemble(probs, truth=truth).select("id", "pred", "confidence", "label", "accuracy")


@register("quality_alerts", operators="N15 (per-day error rate > 5%, accuracy < 0.8)",
          sql=with_views("""SELECT CAST((s.ts // 86400) * 86400 AS BIGINT) AS window_start,
  AVG(CASE WHEN t.id IS NULL OR t.source_account IS NULL OR TRY_CAST(t.amount AS DOUBLE) IS NULL THEN 1.0 ELSE 0.0 END) AS error_rate,
  AVG(CAST(s.y_pred = s.y_true AS DOUBLE)) AS accuracy,
  AVG(CASE WHEN t.id IS NULL OR t.source_account IS NULL OR TRY_CAST(t.amount AS DOUBLE) IS NULL THEN 1.0 ELSE 0.0 END) > 0.05 AS error_alert,
  AVG(CAST(s.y_pred = s.y_true AS DOUBLE)) < 0.8 AS accuracy_alert
FROM scored s JOIN txn2 t ON t.seq = s.id * 2 GROUP BY 1""", "scored", "txn"), doubles=["error_rate", "accuracy"])
def q_quality_alerts(spark, sf_dir):
    v = qa.validate(txn(spark, sf_dir).where(F.col("seq") % 2 == 0), ["id", "source_account"], {"amount": "double"})
    s = scored(spark, sf_dir).join(v.select((F.col("seq") / 2).cast("long").alias("id"), "is_valid"), "id")
    return dc.quality_alerts(s, 86400).withColumn("window_start", F.col("window_start").cast("long"))
