"""Data quality: dedupe, validation, integrity, hardening flags, key/check/FK constraints,
fraud-report admissibility (Q1-Q5, Q12-Q15, F9, F10, W10).

Errors are returned as rows / array columns; an operator raises only when declared strict.
"First occurrence" always means smallest ``order_col`` (an ingest sequence), never the
physical row order.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import record_hash

ERROR_STRUCT = "struct<error_type:string,field:string,message:string>"


def with_hash(df: DataFrame, fields: list[str], out: str = "hash") -> DataFrame:
    """X5 on rows: SHA-256 of the canonical text of ``fields`` (nulls omitted)."""
    return df.withColumn(out, record_hash({f: F.col(f) for f in fields}))


def mark_duplicates(df: DataFrame, hash_col: str, order_col: str, out: str = "is_duplicate") -> DataFrame:
    """First occurrence per hash (smallest order_col) is kept, later ones are duplicates.

    ``min(order_col) over hash`` is a partial aggregate joined back, so a hot hash value is
    combined map-side instead of sorted in one window task."""
    firsts = df.groupBy(hash_col).agg(F.min(order_col).alias("_first"))
    firsts = firsts.withColumnRenamed(hash_col, "_h")      # a null hash is a value like others
    return (df.join(firsts, F.col(hash_col).eqNullSafe(F.col("_h")))
            .withColumn(out, F.col(order_col) != F.col("_first")).drop("_first", "_h"))


def deduplicate(df: DataFrame, hash_col: str, order_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Q1: (unique rows, duplicate rows, conflict records) for a hashed frame."""
    m = mark_duplicates(df, hash_col, order_col)
    uniq = m.where(~F.col("is_duplicate")).drop("is_duplicate")
    dups = m.where(F.col("is_duplicate")).drop("is_duplicate")
    conflicts = dups.select(F.col("id").alias("transaction_id"), F.col(hash_col).alias("hash"),
                            F.lit("DUPLICATE").alias("conflict_type"), F.col(order_col).alias("seq"),
                            F.lit("duplicate of an earlier record").alias("message"))
    return uniq, dups, conflicts


def dedupe_against_seen(batch: DataFrame, seen: DataFrame, hash_col: str, order_col: str) -> DataFrame:
    """Q2: rows of a new batch whose hash is in neither the seen-hash table nor earlier in the
    batch (anti join + first-per-hash)."""
    fresh = batch.join(seen.select(hash_col).distinct(), hash_col, "left_anti")
    return mark_duplicates(fresh, hash_col, order_col).where(~F.col("is_duplicate")).drop("is_duplicate")


def validate(df: DataFrame, required: list[str] = ("id",), types: dict[str, str] | None = None,
             stored_hash_col: str | None = None, hash_col: str | None = None,
             raw_json_col: str | None = None) -> DataFrame:
    """Q3/Q4: add ``errors`` (array of struct(error_type, field, message)) and ``is_valid``.

    MISSING_FIELD: a required field is null; INVALID_TYPE: raw value present but not castable to
    the declared type; HASH_MISMATCH: stored hash differs from the computed one;
    MALFORMED_STRUCTURE: the raw JSON text does not parse to an object.  All errors are kept."""
    checks = []
    for f in required:
        checks.append(F.when(F.col(f).isNull(), F.struct(
            F.lit("MISSING_FIELD").alias("error_type"), F.lit(f).alias("field"),
            F.lit(f"Required field '{f}' is missing or null").alias("message"))))
    for f, t in (types or {}).items():
        checks.append(F.when(F.col(f).isNotNull() & F.col(f).try_cast(t).isNull(), F.struct(
            F.lit("INVALID_TYPE").alias("error_type"), F.lit(f).alias("field"),
            F.lit(f"Field '{f}' is not a valid {t}").alias("message"))))
    if stored_hash_col and hash_col:
        checks.append(F.when(F.col(stored_hash_col).isNotNull() & (F.col(stored_hash_col) != F.col(hash_col)),
                             F.struct(F.lit("HASH_MISMATCH").alias("error_type"), F.lit(None).cast("string").alias("field"),
                                      F.lit("Hash mismatch").alias("message"))))
    if raw_json_col:
        obj = F.try_parse_json(F.col(raw_json_col))
        checks.append(F.when(obj.isNull() | (F.schema_of_variant(obj).substr(1, 6) != "OBJECT"), F.struct(
            F.lit("MALFORMED_STRUCTURE").alias("error_type"), F.lit(None).cast("string").alias("field"),
            F.lit("Transaction is not an object").alias("message"))))
    errs = F.filter(F.array(*checks), lambda e: e.isNotNull()) if checks else F.array().cast(f"array<{ERROR_STRUCT}>")
    return df.withColumn("errors", errs).withColumn("is_valid", F.size("errors") == 0)


def integrity(df: DataFrame, hash_col: str, order_col: str, required: list[str] = ("id",),
              types: dict[str, str] | None = None, strict: bool = False) -> DataFrame:
    """Q5: status per row: 'corrupt' (validation errors) first, then 'duplicate' (hash seen
    earlier among non-corrupt rows), else 'valid'.  Strict mode raises on any non-valid row
    (one count action)."""
    v = validate(df, required, types)
    ok = v.where(F.col("is_valid"))
    bad = v.where(~F.col("is_valid"))
    okm = mark_duplicates(ok, hash_col, order_col)
    out = okm.withColumn("status", F.when(F.col("is_duplicate"), F.lit("duplicate")).otherwise(F.lit("valid"))) \
        .drop("is_duplicate").unionByName(bad.withColumn("status", F.lit("corrupt")))
    if strict:
        n_bad = out.where(F.col("status") != "valid").count()
        if n_bad:
            raise ValueError(f"{n_bad} records failed the integrity check")
    return out


def conflict_records(status: DataFrame, hash_col: str, order_col: str) -> DataFrame:
    """One conflict row for every corrupt and every duplicate record."""
    return status.where(F.col("status") != "valid").select(
        F.col("id").alias("transaction_id"), F.col(hash_col).alias("hash"),
        F.upper(F.col("status")).alias("conflict_type"), F.col(order_col).alias("seq"),
        F.when(F.col("status") == "corrupt", F.array_join(F.transform("errors", lambda e: e["error_type"]), ","))
         .otherwise(F.lit("duplicate of an earlier record")).alias("message"))


def hardening_flags(df: DataFrame, memo_col: str | None = None, count_cols: list[str] = (),
                    hash_col: str | None = None, score_col: str | None = None) -> DataFrame:
    """memo longer than 28 bytes, negative counts, hash not 64 hex chars, score outside 0-100."""
    out = df
    if memo_col:
        out = out.withColumn("memo_too_long", F.coalesce(F.octet_length(memo_col) > 28, F.lit(False)))
    if count_cols:
        neg = F.lit(False)
        for c in count_cols:
            neg = neg | F.coalesce(F.col(c) < 0, F.lit(False))
        out = out.withColumn("negative_count", neg)
    if hash_col:
        out = out.withColumn("bad_hash", ~F.coalesce(F.col(hash_col).rlike("^[0-9a-fA-F]{64}$"), F.lit(False)))
    if score_col:
        out = out.withColumn("bad_score", ~F.coalesce(F.col(score_col).between(0, 100), F.lit(False)))
    return out


def duplicate_keys(df: DataFrame, keys: list[str | Column]) -> DataFrame:
    """Q12: key values that occur more than once (GROUP BY ... HAVING count > 1)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def check_violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Q13: one row with the number of rows violating each named check (null -> not violated,
    as SQL CHECK)."""
    return df.agg(*[F.sum(F.when(~F.coalesce(c, F.lit(True)), 1).otherwise(0)).cast("long").alias(n)
                    for n, c in checks.items()])


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Q14: child rows whose non-null foreign key has no parent (left anti join)."""
    return child.where(F.col(fk).isNotNull()).join(
        parent.select(F.col(pk).alias(fk)).distinct(), fk, "left_anti")


# Registry defaults of the fraud-report rules.
MIN_REPUTATION, MIN_CONFIDENCE, CONSENSUS_THRESHOLD = 50, 60, 3


def admissible_reports(reports: DataFrame, validators: DataFrame, order_col: str,
                       min_reputation: int = MIN_REPUTATION, min_confidence: int = MIN_CONFIDENCE) -> DataFrame:
    """Reject reason per report: unknown validator, inactive, reputation < min,
    confidence < min, or an earlier *accepted* report of the same (account, validator); 'ok'
    otherwise.  A rejected report is not stored, so it does not block a later one.
    The validator table is joined by key (no size assumption)."""
    r = reports.join(validators.select("validator", "reputation", "is_active"), "validator", "left")
    passes = F.col("is_active") & (F.col("reputation") >= min_reputation) & (F.col("confidence") >= min_confidence)
    first = r.where(passes).groupBy("account_id", "validator").agg(F.min(order_col).alias("_first"))
    r = r.join(first, ["account_id", "validator"], "left")
    reason = (F.when(F.col("reputation").isNull(), F.lit("unknown_validator"))
              .when(~F.col("is_active"), F.lit("inactive_validator"))
              .when(F.col("reputation") < min_reputation, F.lit("low_reputation"))
              .when(F.col("confidence") < min_confidence, F.lit("low_confidence"))
              .when(F.col(order_col) != F.col("_first"), F.lit("already_reported"))
              .otherwise(F.lit("ok")))
    return r.withColumn("decision", reason).drop("_first")


def fraud_consensus(admitted: DataFrame, threshold: int = CONSENSUS_THRESHOLD) -> DataFrame:
    """Accounts reported by at least ``threshold`` distinct validators (HAVING)."""
    return (admitted.groupBy("account_id").agg(F.count_distinct("validator").alias("validators"))
            .where(F.col("validators") >= threshold))


def validator_stats(admitted: DataFrame, validators: DataFrame) -> DataFrame:
    """report_count per validator (admitted reports) and active flag."""
    c = admitted.groupBy("validator").agg(F.count(F.lit(1)).alias("report_count"))
    return validators.join(c, "validator", "left").fillna({"report_count": 0})
