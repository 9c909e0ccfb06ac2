"""Scalar column operators: memo parsing (X4), record hashing (X5), ISO time parsing (X6),
time encoding (X10), edge features (X11), augmentation (X12), temperature scaling (X13)."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX64 = "^[0-9a-f]{64}$"
U64_MAX = "18446744073709551615"


def parse_iso_timestamp(col: Column) -> Column:
    """ISO-8601 text ('...Z' or with offset) -> timestamp (UTC); unparsable -> null."""
    txt = F.regexp_replace(col, "Z$", "+00:00")
    return F.coalesce(F.try_to_timestamp(txt, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX")),
                      F.try_to_timestamp(col))


def parse_memo(memo_type: Column, memo_value: Column) -> Column:
    """struct(type, value, length, is_malformed) of a (type, value) memo.

    text: value kept, length = its character count; id: integer 0..2^64-1 (optional spaces and
    sign accepted) kept as a decimal string; hash: 64 hex chars, lower-cased.  A bad value keeps
    the type with a null value and is malformed; an unknown or missing type -> 'none', malformed.
    """
    t = F.lower(memo_type)
    idv = F.trim(memo_value).try_cast("decimal(20,0)")
    id_ok = idv.isNotNull() & (idv >= 0) & (idv <= F.lit(U64_MAX).cast("decimal(20,0)")) \
        & F.trim(memo_value).rlike("^[+-]?[0-9]+$")
    hv = F.lower(memo_value)
    hash_ok = hv.rlike(HEX64)
    missing = memo_type.isNull() | memo_value.isNull()
    typ = (F.when(missing, F.lit("none"))
           .when(t.isin("text", "id", "hash"), t).otherwise(F.lit("none")))
    value = (F.when(missing, F.lit(None).cast("string"))
             .when(t == "text", memo_value)
             .when((t == "id") & id_ok, idv.cast("string"))
             .when((t == "hash") & hash_ok, hv))
    malformed = (F.when(missing, F.lit(True))
                 .when(t == "text", F.lit(False))
                 .when(t == "id", ~id_ok)
                 .when(t == "hash", ~hash_ok)
                 .otherwise(F.lit(True)))
    length = F.when((typ == "text") & value.isNotNull(), F.length(value)).otherwise(F.lit(0))
    return F.struct(typ.alias("type"), value.alias("value"), length.alias("length"),
                    malformed.alias("is_malformed"))


def canonical_record(fields: dict[str, Column]) -> Column:
    """X5 canonical text: sorted field names, 'name=value' joined by U+001F; nulls omitted.

    Doubles are rendered by Spark's cast to string, once, so equal values hash equal."""
    parts = [F.when(c.isNotNull(), F.concat(F.lit(f"{k}="), c.cast("string")))
             for k, c in sorted(fields.items())]
    return F.concat_ws("\u001f", *parts)


def record_hash(fields: dict[str, Column]) -> Column:
    """SHA-256 hex of the canonical record text."""
    return F.sha2(canonical_record(fields), 256)


def time_encoding(t: Column, max_time: Column | float, dim: int = 16) -> Column:
    """Sinusoidal encoding of index = floor(t / max_time * dim) mod dim, as
    array(sin(i / 10000^(2k/dim)), cos(...)) for k < dim/2 (standard formula)."""
    mt = max_time if isinstance(max_time, Column) else F.lit(float(max_time))
    idx = F.pmod(F.floor(t / mt * dim), F.lit(dim)).cast("double")
    vals = []
    for k in range(dim // 2):
        div = math.pow(10000.0, 2.0 * k / dim)
        vals += [F.sin(idx / div), F.cos(idx / div)]
    return F.array(*vals)


def draw60(*parts: Column) -> Column:
    """A reproducible 60-bit number from the texts of ``parts``: the first 15 hex digits of the MD5
    of the values joined by ``|`` (nulls left out).  Any SQL engine can repeat it (``sql_draw60``)."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def sql_draw60(*parts: str) -> str:
    """The DuckDB twin of :func:`draw60`."""
    return f"CAST('0x' || SUBSTR(MD5(CONCAT_WS('|', {', '.join(f'CAST({p} AS VARCHAR)' for p in parts)})), 1, 15) AS BIGINT)"


def op_type_feature(op_type: Column) -> Column:
    """X11: stable hash of the operation type mod 1000 / 1000 (the reference's Python hash is
    salted per process, so only the range and stability carry over)."""
    return F.pmod(draw60(op_type), F.lit(1000)) / F.lit(1000.0)


def time_noise(t: Column, scale: float, seed: int, key: Column) -> Column:
    """T + N(0, scale) noise clamped to [0, 1]; the draw hashes (key, seed) so it does
    not depend on partitioning."""
    u1 = (F.pmod(draw60(key, F.lit(seed), F.lit(1)), F.lit(1 << 30)) + 1) / F.lit(float((1 << 30) + 1))
    u2 = F.pmod(draw60(key, F.lit(seed), F.lit(2)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    z = F.sqrt(-2.0 * F.log(u1)) * F.cos(2 * math.pi * u2)
    return F.least(F.greatest(t + F.lit(scale) * z, F.lit(0.0)), F.lit(1.0))


def uniform(key: Column, seed: int, salt: int = 0) -> Column:
    """A [0, 1) draw from a hash of (key, seed, salt): stable under re-partitioning and retries."""
    return F.pmod(draw60(key, F.lit(seed), F.lit(salt)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def age_weighted_keep(t_norm: Column, key: Column, drop_rate: float, seed: int) -> Column:
    """X12 edge dropout: older edges (small t) are dropped with probability drop_rate * (1 - t)."""
    return uniform(key, seed, 3) >= F.lit(drop_rate) * (F.lit(1.0) - t_norm)


def temperature_scale(p: Column, temperature: float) -> Column:
    """sigmoid(logit(p) / T) with p clipped to [1e-15, 1 - 1e-15]."""
    pc = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    logit = F.log(pc / (F.lit(1.0) - pc))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit / F.lit(float(temperature))))
