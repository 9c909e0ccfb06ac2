"""Parsing, normalisation, quality and split operators with the reference's fixture rows."""
import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.scalar import parse_memo
from ledgerloom.operators import ingest as ig
from ledgerloom.operators import quality as qa
from ledgerloom.operators import splits as sp

PAYMENT = {"id": "1", "paging_token": "1", "transaction_successful": True, "source_account": "G_SENDER",
           "type": "payment", "type_i": 1, "created_at": "2024-01-15T12:30:00Z", "transaction_hash": "a_hash",
           "to": "G_RECEIVER", "from": "G_SENDER", "amount": "100.5000000", "asset_type": "native"}
CREATE = {"id": "2", "source_account": "G_FUNDER", "type": "create_account", "created_at": "2024-01-15T12:31:00Z",
          "transaction_hash": "b_hash", "account": "G_NEW_ACCOUNT", "funder": "G_FUNDER", "starting_balance": "1000.0000000"}
TRUST = {"id": "3", "source_account": "G_TRUSTOR", "type": "change_trust", "created_at": "2024-01-15T12:32:00Z",
         "transaction_hash": "c_hash", "asset_type": "credit_alphanum4", "asset_code": "USDC", "asset_issuer": "G_ISSUER",
         "trustor": "G_TRUSTOR"}


def raw(spark, recs):
    return spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(recs)], "seq long, raw string")


def test_normalize_golden_rows(spark):
    out = {r.transaction_hash: r for r in ig.normalize_operations(raw(spark, [PAYMENT, CREATE, TRUST])).collect()}
    assert (out["a_hash"].sender, out["a_hash"].receiver, out["a_hash"].amount, out["a_hash"].asset) == \
        ("G_SENDER", "G_RECEIVER", 100.5, "XLM")
    assert (out["b_hash"].sender, out["b_hash"].receiver, out["b_hash"].amount, out["b_hash"].asset) == \
        ("G_FUNDER", "G_NEW_ACCOUNT", 1000.0, "XLM" if False else "UNKNOWN")
    assert (out["c_hash"].receiver, out["c_hash"].amount, out["c_hash"].asset) == (None, None, "USDC:G_ISSUER")


def test_path_payment_one_hop_takes_source_amount(spark):
    p = dict(PAYMENT, type="path_payment_strict_send", source_amount="5.0", destination_amount="4.0",
             amount="4.0", asset_type="credit_alphanum4", asset_code="USDC", asset_issuer="GI", path=[])
    hops = ig.path_payment_hops(raw(spark, [p])).collect()
    assert len(hops) == 1 and hops[0].amount == 5.0 and hops[0].is_first_hop and hops[0].is_last_hop
    p2 = dict(p, path=[{"asset_type": "credit_alphanum4", "asset_code": "EURC", "asset_issuer": "GE"}])
    h = sorted(ig.path_payment_hops(raw(spark, [p2])).collect(), key=lambda r: r.hop_index)
    # no source_asset_type: the source asset falls back to the destination asset fields
    assert [x.asset for x in h] == ["USDC:GI", "EURC:GE"] and [x.amount for x in h] == [5.0, 4.0]
    assert h[0].to_account == "__path__a_hash_1" == h[1].from_account


def test_backfill_rows(spark):
    rows = spark.createDataFrame([
        ("10", "200", "payment", "G_SENDER", "G_RECEIVER", None, "12.5", None, "native", None, None, "2024-01-01T00:00:00Z", "h1"),
        ("11", "200", "create_account", "G_SENDER", None, "G_NEW", None, "1000", None, None, None, "2024-01-01T00:00:01Z", "h2"),
        ("12", "201", "change_trust", "G_SENDER", None, None, None, None, "credit_alphanum4", "USDC", "G_ISSUER", "2024-01-01T00:00:02Z", "h3"),
        ("12", "201", "change_trust", "G_SENDER", None, None, None, None, "credit_alphanum4", "USDC", "G_ISSUER", "2024-01-01T00:00:02Z", "h3"),
        ("13", None, "payment", "G_SENDER", "G_X", None, "1", None, "native", None, None, "2024-01-01T00:00:03Z", "h4"),
    ], "id string, ledger string, type string, source_account string, to string, account string, amount string, "
       "starting_balance string, asset_type string, asset_code string, asset_issuer string, created_at string, transaction_hash string")
    out = sorted(ig.normalize_backfill(rows.withColumn("seq", F.monotonically_increasing_id()), "seq").collect(), key=lambda r: r.operation_id)
    assert [r.receiver for r in out] == ["G_RECEIVER", "G_NEW", None]
    assert [r.amount for r in out] == [12.5, 1000.0, None]
    assert [r.asset for r in out] == ["XLM", "UNKNOWN", "USDC:G_ISSUER"]
    assert list(ig.BACKFILL_COLUMNS) == out[0].__fields__


def test_memo_fixture(spark):
    rows = spark.createDataFrame([("text", "hello"), ("id", "42"), ("hash", "a" * 64), ("invalid", "x"), (None, None)],
                                 "t string, v string")
    got = [tuple(r) for r in rows.select(parse_memo(F.col("t"), F.col("v")).alias("m")).select(
        "m.type", "m.length", "m.is_malformed").collect()]
    assert got == [("text", 5, False), ("id", 0, False), ("hash", 0, False), ("none", 0, True), ("none", 0, True)]


def test_integrity_and_dedupe(spark):
    t = spark.createDataFrame([(1, "tx_007", "G1", "1.0", "p", "1"), (2, "tx_007", "G1", "1.0", "p", "1"),
                               (3, "tx_008", "G2", "2.0", "q", "2"), (4, None, "G3", "3.0", "r", "3"),
                               (5, "tx_009", "G4", "not_a_float", "s", "4")],
                              "seq long, id string, source_account string, amount string, payload string, timestamp string")
    h = qa.with_hash(t, ["id", "payload", "timestamp"])
    st = {r.seq: r.status for r in qa.integrity(h, "hash", "seq", ["id", "source_account"], {"amount": "double"}).collect()}
    assert st == {1: "valid", 2: "duplicate", 3: "valid", 4: "corrupt", 5: "corrupt"}
    with pytest.raises(ValueError):
        qa.integrity(h, "hash", "seq", ["id"], {"amount": "double"}, strict=True)


def test_admissibility_and_consensus(spark):
    v = spark.createDataFrame([("v1", 80, True), ("v2", 90, True), ("v3", 70, True), ("v4", 40, True), ("v5", 90, False)],
                              "validator string, reputation int, is_active boolean")
    r = spark.createDataFrame([(1, "v1", 70, 1), (1, "v1", 90, 2), (1, "v2", 65, 3), (1, "v3", 99, 4), (1, "v4", 99, 5),
                               (1, "v5", 99, 6), (2, "v1", 10, 7), (2, "vx", 90, 8)],
                              "account_id long, validator string, confidence int, seq long")
    d = {x.seq: x.decision for x in qa.admissible_reports(r, v, "seq").collect()}
    assert d == {1: "ok", 2: "already_reported", 3: "ok", 4: "ok", 5: "low_reputation", 6: "inactive_validator",
                 7: "low_confidence", 8: "unknown_validator"}
    ok = qa.admissible_reports(r, v, "seq").where("decision = 'ok'")
    assert [x.account_id for x in qa.fraud_consensus(ok).collect()] == [1]


def test_splits(spark):
    df = spark.createDataFrame([(i, 1704067200 + i * 86400) for i in range(10)], "id long, ts long")
    s = {r.id: r.split for r in sp.split_by_ratio(df, "ts", "id", 0.8).collect()}
    assert sum(v == "train" for v in s.values()) == 8 and s[7] == "train" and s[8] == "test"
    c = sp.split_by_cutoff(df, "ts", 1704067200 + 5 * 86400).groupBy("split").count()
    assert {r.split: r["count"] for r in c.collect()} == {"train": 5, "test": 5}
    assert not sp.split_overlap(sp.split_by_ratio(df, "ts", "id", 0.8), "ts").first().overlap
    with pytest.raises(ValueError):
        sp.random_split(df, "id", {"a": 0.5, "b": 0.4})
