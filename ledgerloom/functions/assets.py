"""Asset strings: typing (F8), building (X7), splitting."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stablecoin asset codes recognised by the edge typing.
STABLECOIN_CODES = ["USDC", "USDT", "EURC", "EURT", "BRLT", "NGNT", "IDRT", "ARST", "MXNT", "NGNC"]


def asset_edge_type(asset: Column) -> Column:
    """F8: 0 for XLM, 1 when the upper-cased code (before ':') is a stablecoin, else 2."""
    code = F.upper(F.split(asset, ":").getItem(0))
    return (F.when(asset == "XLM", F.lit(0))
            .when(code.isin(STABLECOIN_CODES), F.lit(1))
            .otherwise(F.lit(2)))


def build_asset(asset_type: Column, code: Column, issuer: Column, code_only_ok: bool = True) -> Column:
    """Native -> XLM; code and issuer -> code:issuer; code only -> code (backfill/hops)
    or UNKNOWN (operation normaliser, ``code_only_ok=False``); nothing -> UNKNOWN."""
    both = F.concat_ws(":", code, issuer)
    return (F.when(asset_type == "native", F.lit("XLM"))
            .when(code.isNotNull() & issuer.isNotNull(), both)
            .when(code.isNotNull() & F.lit(code_only_ok), code)
            .otherwise(F.lit("UNKNOWN")))


def split_asset(asset: Column) -> tuple[Column, Column]:
    """Asset string -> (code, issuer); XLM has no issuer."""
    parts = F.split(asset, ":")
    return parts.getItem(0), F.when(F.size(parts) > 1, parts.getItem(1))


def valid_account_id(col: Column) -> Column:
    """Public account id = 'G' + 55 base32 characters."""
    return col.rlike("^G[A-Z2-7]{55}$")
