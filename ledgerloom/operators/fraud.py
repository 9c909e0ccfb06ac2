"""Fraud patterns, alerts and loyalty views.

Values fixed by the reference (tier thresholds, risk bands, injection defaults) are listed
below as plain constants."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordering import with_cumulative_sums
from ..functions.scalar import uniform

# Injection defaults (clusters, cluster size, tx per member, base amount; loops,
# loop size, rounds, base amount) and relative amount spreads.
SYBIL = {"clusters": 2, "cluster_size": 5, "tx_per_member": 3, "base_amount": 25.0, "spread": 0.2}
WASH = {"loops": 2, "loop_size": 4, "rounds": 5, "base_amount": 100.0, "spread": 0.03}

# Risk bands (high >= 75, medium >= 50, else low).
RISK_HIGH, RISK_MEDIUM = 75, 50

# Loyalty tiers (id, name, threshold, multiplier).
TIERS = [("silver", "Silver", 1500, 1.1), ("gold", "Gold", 3000, 1.25), ("platinum", "Platinum", 6000, 1.5)]


def inject_fraud(tx: DataFrame, seed: int = 7, sybil: dict = SYBIL, wash: dict = WASH) -> DataFrame:
    """Append labelled sybil-cluster and wash-loop rows to an edge table.

    Rows are generated with ``spark.range`` (row r of each pattern is a pure function of r),
    timestamps run max(ts)+1, +2, ... across both patterns, amounts are base*(1 +- spread) from
    a hash of (seed, pattern, r), rounded to 7 decimals.  Sybil: controller <-> member
    alternating by tx parity.  Wash: closed loops of ``loop_size`` accounts for ``rounds``."""
    spark = tx.sparkSession
    start = tx.agg(F.coalesce(F.max("ts"), F.lit(0)).alias("_t0"))
    n_s = sybil["clusters"] * sybil["cluster_size"] * sybil["tx_per_member"]
    n_w = wash["loops"] * wash["rounds"] * wash["loop_size"]
    r = F.col("id")
    per_cluster = sybil["cluster_size"] * sybil["tx_per_member"]
    c = F.floor(r / per_cluster)
    m = F.pmod(F.floor(r / sybil["tx_per_member"]), F.lit(sybil["cluster_size"]))
    t = F.pmod(r, F.lit(sybil["tx_per_member"]))
    ctrl = F.concat(F.lit("sybil_controller_"), c.cast("string"))
    mem = F.concat(F.lit("sybil_"), c.cast("string"), F.lit("_"), m.cast("string"))
    syb = spark.range(n_s).select(
        (r + 1).alias("synthetic_tx_id"),
        F.when(t % 2 == 0, ctrl).otherwise(mem).alias("src"), F.when(t % 2 == 0, mem).otherwise(ctrl).alias("dst"),
        F.round(F.lit(sybil["base_amount"]) * (1 + (uniform(r, seed, 1) * 2 - 1) * sybil["spread"]), 7).alias("amount"),
        (r + 1).alias("_k"), F.lit("sybil_cluster").alias("fraud_pattern"),
        F.to_json(F.struct(c.alias("cluster"), ctrl.alias("controller"), mem.alias("member"))).alias("fraud_metadata"))
    per_loop = wash["rounds"] * wash["loop_size"]
    lp = F.floor(r / per_loop)
    rnd = F.pmod(F.floor(r / wash["loop_size"]), F.lit(wash["rounds"]))
    i = F.pmod(r, F.lit(wash["loop_size"]))
    acct = lambda k: F.concat(F.lit("wash_"), lp.cast("string"), F.lit("_"), k.cast("string"))
    wsh = spark.range(n_w).select(
        (r + 1 + n_s).alias("synthetic_tx_id"), acct(i).alias("src"),
        acct(F.pmod(i + 1, F.lit(wash["loop_size"]))).alias("dst"),
        F.round(F.lit(wash["base_amount"]) * (1 + (uniform(r, seed, 2) * 2 - 1) * wash["spread"]), 7).alias("amount"),
        (r + 1 + n_s).alias("_k"), F.lit("wash_trading_loop").alias("fraud_pattern"),
        F.to_json(F.struct(lp.alias("loop"), rnd.alias("round"))).alias("fraud_metadata"))
    inj = syb.unionByName(wsh).crossJoin(F.broadcast(start)) \
        .withColumn("ts", F.col("_t0") + F.col("_k")).drop("_t0", "_k").withColumn("synthetic_fraud", F.lit(True))
    base = tx.withColumn("synthetic_fraud", F.lit(False))
    return base.unionByName(inj, allowMissingColumns=True)


def injection_summary(augmented: DataFrame) -> DataFrame:
    """Rows per pattern (original rows under 'original')."""
    return augmented.groupBy(F.coalesce("fraud_pattern", F.lit("original")).alias("pattern")).agg(
        F.count(F.lit(1)).alias("n"), F.min("amount").alias("min_amount"), F.max("amount").alias("max_amount"))


def risk_band(score) -> F.Column:
    """High >= 75, medium >= 50, else low."""
    return F.when(score >= RISK_HIGH, "high").when(score >= RISK_MEDIUM, "medium").otherwise("low")


def alert_summary(alerts: DataFrame) -> DataFrame:
    """Alerts by band and pattern with their mean score."""
    return alerts.groupBy(risk_band(F.col("risk_score")).alias("band"), "pattern").agg(
        F.count(F.lit(1)).alias("alerts"), F.avg("risk_score").alias("mean_score"))


def risk_over_time(alerts: DataFrame) -> DataFrame:
    """Mean risk score per day."""
    return alerts.groupBy(F.date_from_unix_date(F.floor(F.col("ts") / 86400).cast("int")).alias("day")) \
        .agg(F.avg("risk_score").alias("score"))


def points_ledger(points: DataFrame) -> DataFrame:
    """Running balance per account in (ts, id) order; a redemption (negative points) is
    valid when 0 < -points <= balance before it.  Running sums are range-partitioned per
    account (no single window task per account)."""
    c = with_cumulative_sums(points, ["account", "ts", "id"], ["points"], partition_cols=["account"])
    before = F.col("cum_points") - F.col("points")
    return c.withColumn("balance_before", before).withColumn(
        "valid", F.when(F.col("points") < 0, (-F.col("points") > 0) & (-F.col("points") <= before)).otherwise(F.lit(True)))


def tier_lookup(balances: DataFrame, balance_col: str = "balance") -> DataFrame:
    """Current tier = highest threshold <= balance (none below the first), next tier =
    lowest threshold above; remaining points and progress %.  The tier table has 3 rows."""
    spark = balances.sparkSession
    tiers = spark.createDataFrame([(i, n, t, m) for i, n, t, m in TIERS], "tier string, tier_name string, threshold long, multiplier double")
    b = balances.crossJoin(F.broadcast(tiers))
    cur = F.max_by(F.when(F.col(balance_col) >= F.col("threshold"), F.col("tier")),
                   F.when(F.col(balance_col) >= F.col("threshold"), F.col("threshold")))
    nxt_t = F.min(F.when(F.col(balance_col) < F.col("threshold"), F.col("threshold")))
    nxt = F.min_by(F.when(F.col(balance_col) < F.col("threshold"), F.col("tier")),
                   F.when(F.col(balance_col) < F.col("threshold"), F.col("threshold")))
    keys = [c for c in balances.columns]
    g = b.groupBy(*keys).agg(cur.alias("tier"), nxt.alias("next_tier"), nxt_t.alias("next_threshold"))
    # progress rounds like the reference UI (half up towards +inf); no next tier -> 100%
    nt = F.col("next_threshold")
    return g.withColumn("remaining_to_upgrade", F.when(nt.isNotNull(), F.greatest(nt - F.col(balance_col), F.lit(0)))) \
        .withColumn("progress_pct", F.coalesce(F.least(F.lit(100.0), F.floor(F.col(balance_col) / nt * 100 + 0.5).cast("double")),
                                              F.lit(100.0)))


def history_page(points: DataFrame, account, page: int, page_size: int) -> tuple[DataFrame, DataFrame]:
    """One page of an account's history (newest first, ties by id) and the total count.
    The limit is the feature here; ``offset`` + ``limit`` run as a distributed top-k."""
    h = points.where(F.col("account") == F.lit(account))
    pg = h.orderBy(F.col("ts").desc(), F.col("id").desc()).offset(page * page_size).limit(page_size)
    return pg, h.agg(F.count(F.lit(1)).alias("total"))


def pool_concentration(holdings: DataFrame, pool_col: str = "asset", holder_col: str = "account",
                       amount_col: str = "balance", top: int = 3) -> DataFrame:
    """Share of the ``top`` largest positive holders in each pool.  ``row_number <= top``
    is applied per map partition first (window group limit), so big pools stay cheap."""
    pos = holdings.where(F.col(amount_col) > 0)
    w = Window.partitionBy(pool_col).orderBy(F.col(amount_col).desc(), F.col(holder_col))
    topk = pos.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top) \
        .groupBy(pool_col).agg(F.sum(amount_col).alias("_top"))
    tot = pos.groupBy(pool_col).agg(F.sum(amount_col).alias("_tot"))
    return tot.join(topk, pool_col).select(pool_col, (F.col("_top") / F.col("_tot")).alias("top_share"))


def lp_velocity(ops: DataFrame, window_seconds: int = 86400) -> DataFrame:
    """Deposits (create_account) and withdrawals (account_merge) per time window."""
    w = F.floor(F.col("ts") / window_seconds) * window_seconds
    return ops.groupBy(w.alias("window_start")).agg(
        F.sum((F.col("type") == "create_account").cast("long")).alias("creations"),
        F.sum((F.col("type") == "account_merge").cast("long")).alias("withdrawals"))


def daily_rollup(edges: DataFrame) -> DataFrame:
    """Per account and day, with rollup subtotals over asset (account, day, asset) ->
    (account, day) -> (account) -> total: transactions and volume."""
    ep = edges.select(F.col("src").alias("account"), F.date_from_unix_date(F.floor(F.col("ts") / 86400).cast("int")).alias("day"), "asset",
                      F.col("amount").cast("decimal(38,7)").alias("amount"))
    return ep.rollup("account", "day", "asset").agg(
        F.count(F.lit(1)).alias("tx_count"), F.sum("amount").cast("double").alias("volume"),
        F.grouping_id().alias("level"))
