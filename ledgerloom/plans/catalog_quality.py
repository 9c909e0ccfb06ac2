"""Registered queries: data quality, constraints, fraud registry, splits and leakage."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import sql_draw60
from ..operators import quality as qa
from ..operators import splits as sp
from ..sources.adapters import acct_edges, epoch_seconds, reports, txn, validators, with_views
from ..sources.tables import read_table
from .registry import register

_HASH_SQL = ("sha256(concat_ws(chr(31), CASE WHEN id IS NOT NULL THEN 'id=' || id END, 'payload=' || payload, "
             "'timestamp=' || \"timestamp\"))")

_STATUS_SQL = f"""h AS (SELECT *, {_HASH_SQL} AS hash, id IS NULL AS e_id, source_account IS NULL AS e_src,
       amount IS NOT NULL AND TRY_CAST(amount AS DOUBLE) IS NULL AS e_amt FROM txn2),
v AS (SELECT *, NOT (e_id OR e_src OR e_amt) AS ok FROM h),
st AS (SELECT seq, id, hash, CASE WHEN NOT ok THEN 'corrupt'
              WHEN seq > MIN(seq) OVER (PARTITION BY hash, ok) THEN 'duplicate' ELSE 'valid' END AS status,
       concat_ws(',', CASE WHEN e_id THEN 'MISSING_FIELD' END, CASE WHEN e_src THEN 'MISSING_FIELD' END,
                 CASE WHEN e_amt THEN 'INVALID_TYPE' END) AS error_types FROM v)"""

_FIELDS = ["id", "payload", "timestamp"]


def _status(spark, sf_dir):
    t = qa.with_hash(txn(spark, sf_dir), _FIELDS)
    return qa.integrity(t, "hash", "seq", required=["id", "source_account"], types={"amount": "double"})


@register("integrity_status", operators="Q5 Q3 X5 W10 (corrupt first, then duplicates)",
          sql=with_views("SELECT seq, id, hash, status, error_types FROM st", "txn", extra=[_STATUS_SQL]))
def q_integrity(spark, sf_dir):
    s = _status(spark, sf_dir)
    return s.select("seq", "id", "hash", "status",
                    F.array_join(F.transform("errors", lambda e: e["error_type"]), ",").alias("error_types"))


@register("integrity_conflicts", operators="Q5 D12 (conflict rows for corrupt and duplicate)",
          sql=with_views("""SELECT id AS transaction_id, hash, upper(status) AS conflict_type, seq,
  CASE WHEN status = 'corrupt' THEN error_types ELSE 'duplicate of an earlier record' END AS message
FROM st WHERE status <> 'valid'""", "txn", extra=[_STATUS_SQL]))
def q_conflicts(spark, sf_dir):
    return qa.conflict_records(_status(spark, sf_dir), "hash", "seq")


@register("valid_unique_rows", operators="F9 (valid and first occurrence only)",
          sql=with_views("SELECT seq, id FROM st WHERE status = 'valid'", "txn", extra=[_STATUS_SQL]))
def q_valid_rows(spark, sf_dir):
    return _status(spark, sf_dir).where(F.col("status") == "valid").select("seq", "id")


@register("dedupe", operators="Q1 (hash duplicates, first wins, conflicts)",
          sql=with_views(f"""SELECT id AS transaction_id, hash, 'DUPLICATE' AS conflict_type, seq,
  'duplicate of an earlier record' AS message
FROM (SELECT *, {_HASH_SQL} AS hash FROM txn2) h
WHERE seq > (SELECT MIN(seq) FROM (SELECT seq, {_HASH_SQL} AS hash2 FROM txn2) z WHERE z.hash2 = h.hash)""", "txn"))
def q_dedupe(spark, sf_dir):
    _, _, conflicts = qa.deduplicate(qa.with_hash(txn(spark, sf_dir), _FIELDS), "hash", "seq")
    return conflicts


@register("validation_errors", operators="Q3 Q4 (all errors per record, stored-hash check)",
          sql=with_views(f"""SELECT error_type, CAST(COUNT(*) AS BIGINT) AS n FROM (
  SELECT 'MISSING_FIELD' AS error_type FROM txn2 WHERE id IS NULL
  UNION ALL SELECT 'MISSING_FIELD' FROM txn2 WHERE source_account IS NULL
  UNION ALL SELECT 'INVALID_TYPE' FROM txn2 WHERE amount IS NOT NULL AND TRY_CAST(amount AS DOUBLE) IS NULL
  UNION ALL SELECT 'HASH_MISMATCH' FROM (SELECT seq, {_HASH_SQL} AS hash FROM txn2) h WHERE seq % 2 = 1) e
GROUP BY error_type""", "txn"))
def q_validation_errors(spark, sf_dir):
    t = qa.with_hash(txn(spark, sf_dir), _FIELDS)
    # the replayed copies (odd seq) carry a tampered stored hash
    t = t.withColumn("stored_hash", F.when(F.col("seq") % 2 == 1, F.sha2(F.lit("tampered"), 256))
                     .otherwise(F.col("hash")))
    v = qa.validate(t, ["id", "source_account"], {"amount": "double"}, "stored_hash", "hash")
    return v.select(F.explode("errors").alias("e")).groupBy(F.col("e.error_type").alias("error_type")) \
        .agg(F.count(F.lit(1)).alias("n"))


@register("duplicate_keys", operators="Q12 (GROUP BY key HAVING count > 1)",
          sql=with_views("SELECT id, CAST(COUNT(*) AS BIGINT) AS n FROM txn2 GROUP BY id HAVING COUNT(*) > 1", "txn"))
def q_dup_keys(spark, sf_dir):
    return qa.duplicate_keys(txn(spark, sf_dir), ["id"])


@register("check_violations", operators="Q13 (CHECK constraints as violation counts)",
          sql=with_views("""SELECT CAST(SUM(CASE WHEN src = dst THEN 1 ELSE 0 END) AS BIGINT) AS distinct_accounts,
  CAST(SUM(CASE WHEN amount < 0 THEN 1 ELSE 0 END) AS BIGINT) AS non_negative_amount,
  CAST(SUM(CASE WHEN dst IS NULL THEN 0 WHEN asset IN ('XLM', 'USDC:GA', 'EURC:GB', 'ABC:GC') THEN 0 ELSE 1 END) AS BIGINT) AS known_asset
FROM acct_edges_all""", "acct_edges_all"))
def q_checks(spark, sf_dir):
    e = acct_edges(spark, sf_dir, keep_all=True)
    return qa.check_violations(e, {
        "distinct_accounts": F.col("src") != F.col("dst"),
        "non_negative_amount": F.col("amount") >= 0,
        "known_asset": F.when(F.col("dst").isNull(), F.lit(True))
                        .otherwise(F.col("asset").isin("XLM", "USDC:GA", "EURC:GB", "ABC:GC"))})


@register("foreign_key_orphans", operators="Q14 (left anti join per foreign key)",
          sql="""SELECT
  (SELECT CAST(COUNT(*) AS BIGINT) FROM lineitem WHERE l_orderkey IS NOT NULL AND l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS lineitem_orders,
  (SELECT CAST(COUNT(*) AS BIGINT) FROM lineitem WHERE l_partkey IS NOT NULL AND l_partkey NOT IN (SELECT p_partkey FROM part)) AS lineitem_part,
  (SELECT CAST(COUNT(*) AS BIGINT) FROM lineitem WHERE l_suppkey IS NOT NULL AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier)) AS lineitem_supplier,
  (SELECT CAST(COUNT(*) AS BIGINT) FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer)) AS orders_customer,
  (SELECT CAST(COUNT(*) AS BIGINT) FROM customer WHERE c_nationkey IS NOT NULL AND c_nationkey NOT IN (SELECT n_nationkey FROM nation)) AS customer_nation""")
def q_orphans(spark, sf_dir):
    t = {n: read_table(spark, sf_dir, n) for n in ("lineitem", "orders", "part", "supplier", "customer", "nation")}
    pairs = {"lineitem_orders": ("lineitem", "l_orderkey", "orders", "o_orderkey"),
             "lineitem_part": ("lineitem", "l_partkey", "part", "p_partkey"),
             "lineitem_supplier": ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
             "orders_customer": ("orders", "o_custkey", "customer", "c_custkey"),
             "customer_nation": ("customer", "c_nationkey", "nation", "n_nationkey")}
    out = None
    for name, (c, fk, p, pk) in pairs.items():
        one = qa.orphans(t[c].select(fk), fk, t[p], pk).agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.crossJoin(one)
    return out


@register("hardening_flags", operators="F10 (memo bytes, negative counts, hash format, score range)",
          sql="""SELECT event_type,
  CAST(SUM(CASE WHEN octet_length(CAST(props || props || props AS BLOB)) > 28 THEN 1 ELSE 0 END) AS BIGINT) AS memo_too_long,
  CAST(SUM(CASE WHEN value - 20 < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative_count,
  CAST(SUM(CASE WHEN regexp_full_match(CASE WHEN event_id % 2 = 0 THEN sha256(props) ELSE md5(props) END, '[0-9a-fA-F]{64}') THEN 0 ELSE 1 END) AS BIGINT) AS bad_hash,
  CAST(SUM(CASE WHEN value BETWEEN 0 AND 100 THEN 0 ELSE 1 END) AS BIGINT) AS bad_score
FROM events GROUP BY event_type""")
def q_hardening(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    x = ev.select("event_type", F.concat("props", "props", "props").alias("memo"),
                  (F.col("value") - 20).alias("cnt"),
                  F.when(F.col("event_id") % 2 == 0, F.sha2("props", 256)).otherwise(F.md5("props")).alias("h"),
                  F.col("value").alias("score"))
    f = qa.hardening_flags(x, "memo", ["cnt"], "h", "score")
    return f.groupBy("event_type").agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in
                                         ("memo_too_long", "negative_count", "bad_hash", "bad_score")])


_ADMIT_SQL = """adm AS (SELECT r.*, v.reputation, v.is_active,
  CASE WHEN v.reputation IS NULL THEN 'unknown_validator' WHEN NOT v.is_active THEN 'inactive_validator'
       WHEN v.reputation < 50 THEN 'low_reputation' WHEN r.confidence < 60 THEN 'low_confidence'
       WHEN r.seq <> MIN(CASE WHEN v.is_active AND v.reputation >= 50 AND r.confidence >= 60 THEN r.seq END)
                      OVER (PARTITION BY r.account_id, r.validator) THEN 'already_reported'
       ELSE 'ok' END AS decision
  FROM reports r LEFT JOIN validators v ON r.validator = v.validator)"""


@register("report_admissibility", operators="Q15 J12 (registry rules)",
          sql=with_views("SELECT seq, account_id, validator, decision FROM adm", "reports", extra=[_ADMIT_SQL]))
def q_admit(spark, sf_dir):
    return qa.admissible_reports(reports(spark, sf_dir), validators(spark), "seq") \
        .select("seq", "account_id", "validator", "decision")


@register("fraud_consensus", operators="G13 (distinct validators >= 3, HAVING)",
          sql=with_views("""SELECT account_id, CAST(COUNT(DISTINCT validator) AS BIGINT) AS validators FROM adm
WHERE decision = 'ok' GROUP BY account_id HAVING COUNT(DISTINCT validator) >= 3""", "reports", extra=[_ADMIT_SQL]))
def q_consensus(spark, sf_dir):
    a = qa.admissible_reports(reports(spark, sf_dir), validators(spark), "seq").where(F.col("decision") == "ok")
    return qa.fraud_consensus(a)


@register("validator_stats", operators="G14 (report counts, active validators)",
          sql=with_views("""SELECT v.validator, CAST(v.reputation AS BIGINT) AS reputation, v.is_active, CAST(COALESCE(c.n, 0) AS BIGINT) AS report_count
FROM validators v LEFT JOIN (SELECT validator, COUNT(*) AS n FROM adm WHERE decision = 'ok' GROUP BY validator) c
  ON v.validator = c.validator""", "reports", extra=[_ADMIT_SQL]))
def q_validator_stats(spark, sf_dir):
    a = qa.admissible_reports(reports(spark, sf_dir), validators(spark), "seq").where(F.col("decision") == "ok")
    return qa.validator_stats(a, validators(spark))


# ----------------------------------------------------------------------------- splits

# lineitem has no unique (orderkey, linenumber) here; (orderkey, linenumber, partkey, suppkey) is unique
_FEAT_SQL = """feat AS (SELECT (l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rid, CAST(epoch_us(l_shipdate) // 1000000 AS BIGINT) AS ts,
  l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag FROM lineitem)"""


def _features(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("rid"),
                     epoch_seconds("l_shipdate").alias("ts"), "l_quantity", "l_extendedprice",
                     "l_discount", "l_tax", "l_returnflag")


@register("split_by_ratio", operators="W13 Q6 (first 80% in time order = train; overlap check)",
          sql=with_views("""SELECT split, CAST(COUNT(*) AS BIGINT) AS n, MIN(ts) AS min_ts, MAX(ts) AS max_ts FROM (
  SELECT ts, CASE WHEN ROW_NUMBER() OVER (ORDER BY ts, rid) - 1 < FLOOR(COUNT(*) OVER () * 0.8) THEN 'train' ELSE 'test' END AS split
  FROM feat) s GROUP BY split""", extra=[_FEAT_SQL]))
def q_split_ratio(spark, sf_dir):
    s = sp.split_by_ratio(_features(spark, sf_dir), "ts", "rid", 0.8)
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))


@register("split_overlap", operators="Q6 Q11 (train max >= test min)",
          sql=with_views("""SELECT MAX(CASE WHEN split = 'train' THEN ts END) AS train_max,
  MIN(CASE WHEN split = 'test' THEN ts END) AS test_min,
  COALESCE(MAX(CASE WHEN split = 'train' THEN ts END) >= MIN(CASE WHEN split = 'test' THEN ts END), false) AS overlap
FROM (SELECT ts, CASE WHEN ROW_NUMBER() OVER (ORDER BY ts, rid) - 1 < FLOOR(COUNT(*) OVER () * 0.8) THEN 'train' ELSE 'test' END AS split
  FROM feat) s""", extra=[_FEAT_SQL]))
def q_split_overlap(spark, sf_dir):
    return sp.split_overlap(sp.split_by_ratio(_features(spark, sf_dir), "ts", "rid", 0.8), "ts")


@register("split_by_cutoff", operators="W14",
          sql=with_views("""SELECT CASE WHEN ts < 820454400 THEN 'train' ELSE 'test' END AS split, CAST(COUNT(*) AS BIGINT) AS n
FROM feat GROUP BY 1""", extra=[_FEAT_SQL]))
def q_split_cutoff(spark, sf_dir):
    return sp.split_by_cutoff(_features(spark, sf_dir), "ts", 820454400).groupBy("split") \
        .agg(F.count(F.lit(1)).alias("n"))


@register("split_three_way", operators="W15 (train/val/test by order)",
          sql=with_views("""SELECT split, CAST(COUNT(*) AS BIGINT) AS n FROM (
  SELECT CASE WHEN r < FLOOR(c * 0.7) THEN 'train' WHEN r < FLOOR(c * 0.7) + FLOOR(c * 0.15) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT ROW_NUMBER() OVER (ORDER BY ts, rid) - 1 AS r, COUNT(*) OVER () AS c FROM feat) x) s GROUP BY split""",
                         extra=[_FEAT_SQL]))
def q_split_three(spark, sf_dir):
    return sp.split_three_way(_features(spark, sf_dir), "ts", "rid").groupBy("split") \
        .agg(F.count(F.lit(1)).alias("n"))


_RID_SQL = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "42"]


@register("random_split", operators="W16 (stable hash split)",
          sql=f"""SELECT CASE WHEN u < 0.7 THEN 'train' WHEN u < {0.7 + 0.1!r} THEN 'val' ELSE 'test' END AS split, CAST(COUNT(*) AS BIGINT) AS n
FROM (SELECT ({sql_draw60(*_RID_SQL)} % {1 << 40}) / {float(1 << 40)!r} AS u FROM lineitem) r GROUP BY 1""")
def q_random_split(spark, sf_dir):
    return sp.random_split(_features(spark, sf_dir), "rid", {"train": 0.7, "val": 0.1, "test": 0.2}) \
        .groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@register("kfold_time_blocked", operators="N13 (time-blocked folds by rank)",
          sql=with_views("""SELECT CAST(fold AS BIGINT) AS fold, CAST(COUNT(*) AS BIGINT) AS n, MIN(ts) AS min_ts, MAX(ts) AS max_ts FROM (
  SELECT ts, FLOOR((ROW_NUMBER() OVER (ORDER BY ts, rid) - 1) * 5 / COUNT(*) OVER ()) AS fold FROM feat) f GROUP BY fold""",
                         extra=[_FEAT_SQL]))
def q_kfold_time(spark, sf_dir):
    f = sp.kfold_time_blocked(_features(spark, sf_dir), "ts", "rid", 5)
    return f.groupBy(F.col("fold").cast("long").alias("fold")).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))


@register("dedupe_against_seen", operators="Q2 (new batch vs a seen-hash table, first per hash)",
          sql=with_views(f"""WITH h AS (SELECT seq, id, {_HASH_SQL} AS hash, CAST("timestamp" AS BIGINT) AS t FROM txn2),
seen AS (SELECT DISTINCT hash FROM h WHERE t < 1705276800),
b AS (SELECT * FROM h WHERE t >= 1705276800 AND hash NOT IN (SELECT hash FROM seen))
SELECT seq, id, hash FROM b WHERE seq = (SELECT MIN(seq) FROM b b2 WHERE b2.hash = b.hash)""", "txn"))
def q_dedupe_seen(spark, sf_dir):
    t = qa.with_hash(txn(spark, sf_dir), _FIELDS).withColumn("t", F.col("timestamp").cast("long"))
    seen = t.where(F.col("t") < 1705276800).select("hash")
    batch = t.where(F.col("t") >= 1705276800)
    return qa.dedupe_against_seen(batch, seen, "hash", "seq").select("seq", "id", "hash")


@register("kfold", operators="N13 (hash folds)",
          sql=f"""SELECT CAST({sql_draw60(*_RID_SQL)} % 5 AS BIGINT) AS fold, CAST(COUNT(*) AS BIGINT) AS n FROM lineitem GROUP BY 1""")
def q_kfold(spark, sf_dir):
    return sp.kfold(_features(spark, sf_dir), "rid", 5).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@register("feature_leakage", operators="Q7 (unsorted time in ingest order, constant columns)",
          sql=with_views("""SELECT 'unsorted_time' AS "check", CAST(COALESCE(SUM(CASE WHEN ts < prev THEN 1 ELSE 0 END), 0) AS BIGINT) AS n
FROM (SELECT ts, LAG(ts) OVER (ORDER BY rid) AS prev FROM feat) x
UNION ALL
SELECT 'constant:' || col, CAST(1 AS BIGINT) FROM (
  SELECT 'l_tax' AS col, COUNT(DISTINCT l_tax) + MAX(CAST(l_tax IS NULL AS INTEGER)) AS d FROM feat
  UNION ALL SELECT 'l_returnflag', COUNT(DISTINCT l_returnflag) + MAX(CAST(l_returnflag IS NULL AS INTEGER)) FROM feat
  UNION ALL SELECT 'one', 1) c WHERE d <= 1""", extra=[_FEAT_SQL]))
def q_feature_leakage(spark, sf_dir):
    f = _features(spark, sf_dir).withColumn("one", F.lit(1))
    return sp.feature_leakage(f, "ts", "rid", ["l_tax", "l_returnflag", "one"])


@register("target_leakage", operators="Q8 (|corr| > 0.95 per feature)",
          sql=with_views("""SELECT feature, corr, ABS(corr) AS abs_corr, ABS(corr) > 0.95 AS leak FROM (
  SELECT 'l_quantity' AS feature, CORR(l_quantity, l_extendedprice) AS corr FROM feat
  UNION ALL SELECT 'l_discount', CORR(l_discount, l_extendedprice) FROM feat
  UNION ALL SELECT 'l_tax', CORR(l_tax, l_extendedprice) FROM feat
  UNION ALL SELECT 'price_copy', CORR(l_extendedprice * 2 + 1, l_extendedprice) FROM feat) c""", extra=[_FEAT_SQL]),
          doubles=["corr", "abs_corr"])
def q_target_leakage(spark, sf_dir):
    f = _features(spark, sf_dir).withColumn("price_copy", F.col("l_extendedprice") * 2 + 1)
    return sp.target_leakage(f, "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "price_copy"])
