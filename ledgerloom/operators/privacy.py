"""Privacy-preserving aggregates (P1-P6; the reference describes them in pseudocode only).

Noise is drawn from a seeded, stateless hash of (key, seed, salt), so a rerun or a retried
task reproduces it.  For integral keys the hash is plain 64-bit arithmetic (reproducible in
SQL); other keys use a hash SQL can repeat."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import draw60
from ..session import cut_lineage

# Amount bucket upper bounds and time-of-day bucket starts (decision table).
AMOUNT_BOUNDS = [1, 10, 100, 1000, 10000]
HOUR_BUCKETS = [0, 4, 8, 12, 16, 20]


def int_uniform(key: Column, seed: int, salt: int) -> Column:
    """(0, 1) draw from an integral key: (((key mod 2^31) * 2654435761 + seed * 40503 + salt * 97) mod 2^32
    + 0.5) / 2^32 (64-bit arithmetic without overflow)."""
    k = F.pmod(key.cast("long"), F.lit(1 << 31))
    h = F.pmod(k * F.lit(2654435761) + F.lit(seed * 40503 + salt * 97), F.lit(1 << 32))
    return (h + F.lit(0.5)) / F.lit(float(1 << 32))


def laplace(u: Column, scale: float | Column) -> Column:
    """Inverse CDF of Laplace(0, b): -b sign(u - 1/2) ln(1 - 2|u - 1/2|)."""
    b = scale if isinstance(scale, Column) else F.lit(float(scale))
    d = u - F.lit(0.5)
    return -b * F.signum(d) * F.log(F.lit(1.0) - F.lit(2.0) * F.abs(d))


def noisy_wallet_stats(tx: DataFrame, wallet_col: str, amount_col: str, ts_col: str, epsilon: float = 1.0,
                       seed: int = 0, sensitivity: dict | None = None) -> DataFrame:
    """Per wallet count, mean amount and active time span, each with Laplace noise of scale
    sensitivity / epsilon (defaults: count 1, mean amount 1000, span 86400)."""
    sens = {"count": 1.0, "mean_amount": 1000.0, "time_span": 86400.0, **(sensitivity or {})}
    g = tx.groupBy(wallet_col).agg(F.count(F.lit(1)).alias("count"),
                                   (F.sum(F.col(amount_col).cast("decimal(38,7)")).cast("double") / F.count(F.lit(1))).alias("mean_amount"),
                                   (F.max(ts_col) - F.min(ts_col)).cast("double").alias("time_span"))
    k = F.col(wallet_col)
    out = g
    for i, m in enumerate(("count", "mean_amount", "time_span")):
        out = out.withColumn(f"noisy_{m}", F.col(m) + laplace(int_uniform(k, seed, i + 1), sens[m] / epsilon))
    return out


def bucket_profile(tx: DataFrame, wallet_col: str, amount_col: str, ts_col: str, counterparty_col: str) -> DataFrame:
    """Counts per wallet x amount bucket x time-of-day bucket x counterparty type
    ('hub' when the counterparty's degree is above twice the mean degree, else 'regular')."""
    amt = F.col(amount_col)
    ab = F.when(amt < AMOUNT_BOUNDS[0], "lt1")
    for lo, hi in zip(AMOUNT_BOUNDS, AMOUNT_BOUNDS[1:]):
        ab = ab.when(amt < hi, f"{lo}-{hi}")
    ab = ab.otherwise(f"ge{AMOUNT_BOUNDS[-1]}")
    hour = F.floor(F.pmod(F.col(ts_col), F.lit(86400)) / 3600)   # UTC hour, independent of the session zone
    tb = F.concat(F.lpad((F.floor(hour / 4) * 4).cast("string"), 2, "0"), F.lit("-"),
                  F.lpad((F.floor(hour / 4) * 4 + 4).cast("string"), 2, "0"))
    deg = tx.select(F.col(counterparty_col).alias("_c")).groupBy("_c").agg(F.count(F.lit(1)).alias("_d"))
    mean = deg.agg(F.avg("_d").alias("_m"))
    typ = deg.crossJoin(F.broadcast(mean)).select("_c", F.when(F.col("_d") > 2 * F.col("_m"), "hub")
                                                  .otherwise("regular").alias("counterparty_type"))
    x = tx.join(typ, tx[counterparty_col] == typ["_c"], "left")
    return x.groupBy(wallet_col, ab.alias("amount_bucket"), tb.alias("time_bucket"), "counterparty_type") \
        .agg(F.count(F.lit(1)).alias("n"))


def wallet_signatures(tx: DataFrame, wallet_col: str, counterparty_col: str, bits: int = 64) -> DataFrame:
    """64-bit behaviour signature per wallet: bit (hash of the counterparty mod 64) set for
    every counterparty (``bit_or`` aggregate)."""
    t = tx.select(wallet_col, F.pmod(draw60(F.col(counterparty_col)), F.lit(bits)).cast("int").alias("_b"))
    return t.groupBy(wallet_col).agg(F.bit_or(F.expr("shiftleft(cast(1 as bigint), _b)")).alias("signature"))


def signature_uniqueness(sigs: DataFrame, wallet_col: str, bits: int = 64) -> DataFrame:
    """uniqueness = 1 - mean Hamming similarity to every other wallet, without pairs:
    with c_b wallets having bit b set among n, wallet w differs from (n - c_b) others on a set
    bit and from c_b others on a clear bit, so
    mean distance = sum_b [w_b ? n - c_b : c_b] / ((n - 1) * bits)."""
    ex = sigs.select(wallet_col, F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("b"),
                     "signature").withColumn("set", F.expr("shiftright(signature, b) & 1") == 1)
    cb = ex.groupBy("b").agg(F.sum(F.col("set").cast("long")).alias("c"))
    n = sigs.agg(F.count(F.lit(1)).alias("_n"))
    x = ex.join(F.broadcast(cb), "b").crossJoin(F.broadcast(n))
    d = x.groupBy(wallet_col, "_n").agg(F.sum(F.when(F.col("set"), F.col("_n") - F.col("c")).otherwise(F.col("c"))).alias("_d"))
    return d.select(wallet_col, F.when(F.col("_n") > 1, F.col("_d") / ((F.col("_n") - 1) * bits)).otherwise(0.0)
                    .alias("uniqueness"))


def signature_classes(sigs: DataFrame, wallet_col: str) -> DataFrame:
    """One row per distinct signature: representative (the smallest wallet) and number of wallets."""
    return sigs.groupBy("signature").agg(F.min(wallet_col).alias("representative"), F.count(F.lit(1)).alias("wallets"))


_CLASSES = 1 << 17      # most classes of a part
_ROWS, _COLUMNS = 16, 8192      # signatures compared at a time


def _near_pairs(a: np.ndarray, b: np.ndarray | None, differing: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in a, in b) of signatures that differ in at most ``differing`` bits; without b, of all
    pairs inside a."""
    found = [], []
    other = a if b is None else b
    for i in range(0, len(a), _ROWS):
        for j in range(0 if b is not None else i // _COLUMNS * _COLUMNS, len(other), _COLUMNS):
            near = np.bitwise_count(a[i:i + _ROWS, None] ^ other[None, j:j + _COLUMNS]) <= differing
            x, y = np.divmod(np.flatnonzero(near), near.shape[1])
            x, y = x + i, y + j
            if b is None:
                x, y = x[x < y], y[x < y]
            found[0].append(x)
            found[1].append(y)
    none = [np.empty(0, np.int64)]
    return np.concatenate(found[0] or none), np.concatenate(found[1] or none)


def similar_classes(classes: DataFrame, bits: int = 64, differing: int | None = None, similarity: float = 0.8,
                    parts: int | None = None) -> DataFrame:
    """Links (a, b, differing) between representatives a < b whose signatures differ in at most
    ``differing`` bits (by default as many as the Hamming similarity allows).

    Classes are dealt by a hash into ``parts`` (at least; by default two pairs of parts per core) and
    every pair of parts is compared whole, as xor and bit count over two arrays, by a task that holds
    no more than these.  The comparisons grow with the square of the classes, as those of any cut
    into keys of a few bits do that allows for so many differing ones, but each is one machine word and
    no row; what is shuffled is each class ``parts`` times.  Equal signatures are one class from the
    start, so a group of equal wallets lists no pairs; all other links are kept."""
    if differing is None:
        differing = int((1 - similarity) * bits + 1e-9)
    known = classes.where(F.col("signature").isNotNull() & F.col("representative").isNotNull())
    wallet = dict(classes.dtypes)["representative"]
    n = known.count()
    cores = classes.sparkSession.sparkContext.defaultParallelism
    parts = max(parts or min(math.isqrt(4 * cores) + 1, n // 512), -(-n // _CLASSES), 1)
    dealt = known.groupBy(F.pmod(F.xxhash64("signature"), F.lit(parts)).alias("i")).agg(
        F.collect_list(F.struct("signature", "representative")).alias("c"))
    dealt = cut_lineage(dealt.select("i", F.col("c.signature").alias("s"), F.col("c.representative").alias("r")))
    # rows of part i go to all pairs (i, j) and (j, i) with i <= j
    left = dealt.select("i", F.explode(F.sequence(F.col("i"), F.lit(parts - 1).cast("long"))).alias("j"), "s", "r")
    right = dealt.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("i"))).alias("k"), *[F.col(c).alias(f"{c}2") for c in "isr"])

    def compare(key, x, y):
        if x.empty or y.empty:
            return pd.DataFrame({c: pd.Series(dtype=object) for c in ("a", "b", "differing")})
        # unsigned: numpy counts the bits of the absolute value of a signed number
        sx, sy = (np.asarray(c.iloc[0], np.int64).view(np.uint64) for c in (x["s"], y["s2"]))
        at, to = _near_pairs(sx, None if key[0] == key[1] else sy, differing)
        return pd.DataFrame({"a": pd.Series(x["r"].iloc[0], dtype=object).iloc[at].to_numpy(),
                             "b": pd.Series(y["r2"].iloc[0], dtype=object).iloc[to].to_numpy(),
                             "differing": np.bitwise_count(sx[at] ^ sy[to]).astype(np.int64)})

    near = left.groupBy("i", "j").cogroup(right.groupBy("k", "i2")).applyInPandas(
        compare, f"a {wallet}, b {wallet}, differing long")
    return near.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "differing")


def similar_wallets(sigs: DataFrame, wallet_col: str, **how) -> DataFrame:
    """Per wallet its class representative and the number of other wallets at least as similar as
    asked, those of its own class included."""
    classes = cut_lineage(signature_classes(sigs, wallet_col))
    links = similar_classes(classes, **how)
    ends = links.select(F.col("a").alias("representative"), F.col("b").alias("other")).unionByName(
        links.select(F.col("b").alias("representative"), F.col("a").alias("other")))
    size = classes.select(F.col("representative").alias("other"), F.col("wallets").alias("_w"))
    near = ends.join(size, "other").groupBy("representative").agg(F.sum("_w").alias("_near"))
    counted = classes.join(near, "representative", "left").select(
        "signature", "representative", (F.col("wallets") - 1 + F.coalesce("_near", F.lit(0))).alias("n_similar"))
    return sigs.select(wallet_col, "signature").join(counted, "signature").select(wallet_col, "representative", "n_similar")


def secret_shares(values: DataFrame, key_col: str, value_col: str, parties: int = 3, seed: int = 0,
                  spread: float = 1e6) -> DataFrame:
    """Additive shares: parties - 1 random shares in [-spread, spread) (7-decimal) and the
    last = value - their sum, all DECIMAL(38,7), so reconstruction is exact."""
    k = F.col(key_col)
    dec = "decimal(38,7)"
    rnd = [F.round((int_uniform(k, seed, 10 + i) * 2 - 1) * spread, 7).cast(dec) for i in range(parties - 1)]
    last = F.col(value_col).cast(dec)
    for r in rnd:
        last = last - r
    return values.select(key_col, F.array(*rnd, last.cast(dec)).alias("shares"))


def reconstruct(shares: DataFrame, key_col: str) -> DataFrame:
    """Sum of shares."""
    return shares.select(key_col, F.aggregate("shares", F.lit(0).cast("decimal(38,7)"),
                                              lambda a, x: (a + x).cast("decimal(38,7)"))
                         .cast("double").alias("value"))


def federated_average(df: DataFrame, party_col: str, x_col: str, y_col: str) -> DataFrame:
    """P5: each party fits y ~ x locally (slope, intercept, n), the federation averages the
    coefficients weighted by n.  Local fits are grouped aggregates (regr_*)."""
    loc = df.groupBy(party_col).agg(F.regr_slope(y_col, x_col).alias("slope"),
                                    F.regr_intercept(y_col, x_col).alias("intercept"), F.count(F.lit(1)).alias("n"))
    return loc.agg((F.sum(F.col("slope") * F.col("n")) / F.sum("n")).alias("slope"),
                   (F.sum(F.col("intercept") * F.col("n")) / F.sum("n")).alias("intercept"),
                   F.count(F.lit(1)).alias("parties"))


def privacy_utility(tx: DataFrame, wallet_col: str, epsilons: list[float], seed: int = 0) -> DataFrame:
    """Per epsilon, mean absolute error of Laplace-noised wallet counts (sensitivity 1).
    The epsilon table has one row per requested value."""
    cnt = tx.groupBy(wallet_col).agg(F.count(F.lit(1)).alias("count"))
    eps = tx.sparkSession.createDataFrame([(float(e),) for e in epsilons], "epsilon double")
    x = cnt.crossJoin(F.broadcast(eps))
    noise = laplace(int_uniform(F.col(wallet_col), seed, 1), F.lit(1.0) / F.col("epsilon"))
    return x.groupBy("epsilon").agg(F.avg(F.abs(noise)).alias("mean_abs_error"),
                                    F.avg(F.abs(noise) / F.col("count")).alias("mean_rel_error"))

