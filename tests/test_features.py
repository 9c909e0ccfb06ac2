"""Per-account features with the reference's hand-computed values."""
import math

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import features as feat
from tests.conftest import as_dict, edges_df

SIMPLE = [("A", "B", 10.0, 1000), ("A", "C", 5.0, 1001), ("B", "C", 7.0, 1002), ("C", "A", 3.0, 1003), ("D", "A", 8.0, 1004)]


def test_degree_centrality_simple(spark):
    d = as_dict(feat.degree_centrality(edges_df(spark, SIMPLE)), "node", "degree_centrality")
    # the code's value for A is 4/3 (A touches four edges); see the survey note
    assert d["A"] == pytest.approx(4 / 3)
    assert d["B"] == pytest.approx(2 / 3)
    assert d["C"] == pytest.approx(1.0)
    assert d["D"] == pytest.approx(1 / 3)


def test_strength_both(spark):
    s = feat.strength(edges_df(spark, SIMPLE), "both")
    d = as_dict(s, "node", "strength")
    assert d == {"A": 26.0, "B": 17.0, "C": 15.0, "D": 8.0}


def test_single_node_degree_is_zero(spark):
    d = as_dict(feat.degree_centrality(edges_df(spark, [("A", "A", 1.0, 1000)])), "node", "degree_centrality")
    assert d == {"A": 0.0}


def test_node_features_fixture(spark):
    e = edges_df(spark, [("A", "B", 10.0, 100, "XLM"), ("A", "C", 5.0, 110, "USDC"),
                         ("B", "A", 2.0, 120, "XLM"), ("C", "A", 3.0, 130, "USDC")], with_asset=True)
    f = {r["node"]: r for r in feat.node_features(e).collect()}
    a = f["A"]
    assert (a.out_degree, a.in_degree, a.total_sent, a.total_received) == (2, 2, 15.0, 5.0)
    assert a.account_age == 30.0 and a.unique_asset_count == 2 and a.asset_entropy == pytest.approx(1.0)
    assert (f["B"].total_sent, f["B"].total_received, f["B"].account_age, f["B"].asset_entropy) == (2.0, 10.0, 30.0, 0.0)
    assert (f["C"].total_sent, f["C"].total_received, f["C"].account_age) == (3.0, 5.0, 20.0)


def test_node_features_first_seen_override(spark):
    e = edges_df(spark, [("A", "B", 10.0, 100)])
    fs = spark.createDataFrame([("A", 90.0), ("B", 95.0), ("D", 50.0)], "node string, first_seen double")
    f = {r["node"]: r for r in feat.node_features(e, fs, ref_time=200).collect()}
    assert f["A"].account_age == 110 and f["B"].account_age == 105 and f["D"].account_age == 150
    assert f["D"].in_degree == 0 and f["D"].total_sent == 0.0


def test_asset_entropy_equal_four(spark):
    e = edges_df(spark, [("A", f"B{i}", 1.0, i, f"T{i}") for i in range(4)], with_asset=True)
    d = as_dict(feat.asset_diversity(e), "node", "asset_entropy")
    assert d["A"] == pytest.approx(2.0)


@pytest.mark.parametrize("sent,received,expected", [(100, 40, 3 / 7), (1, 0, 1.0), (0, 1, -1.0), (5, 5, 0.0), (0, 0, 0.0)])
def test_net_flow_ratio(spark, sent, received, expected):
    r = spark.range(1).select(feat.net_flow_ratio(F.lit(float(sent)), F.lit(float(received))).alias("x")).first().x
    assert r == pytest.approx(expected)


def test_daily_frequency_fixture(spark):
    tx = spark.createDataFrame([("a", "2024-01-01 10:00:00"), ("a", "2024-01-01 12:00:00"), ("a", "2024-01-03 09:00:00"),
                                ("b", "2024-01-05 00:00:00")], "account string, ts string") \
        .withColumn("timestamp", F.to_timestamp("ts"))
    r = {x.account: x for x in feat.daily_frequency(tx).collect()}
    assert (r["a"].mean_tx_per_day, r["a"].std_tx_per_day, r["a"].burstiness) == (1.0, 1.0, 0.0)
    assert (r["b"].mean_tx_per_day, r["b"].std_tx_per_day, r["b"].burstiness) == (1.0, 0.0, -1.0)


def test_burstiness_bounds(spark):
    # generated daily patterns: burstiness stays within [-1, 1]
    ev = spark.read.parquet("/root/testdata/sf0.01/events.parquet").select(
        F.col("user_id").alias("account"), F.col("ts").alias("timestamp"))
    b = feat.daily_frequency(ev).agg(F.min("burstiness"), F.max("burstiness")).first()
    assert -1.0 <= b[0] <= b[1] <= 1.0


def test_decay_lambda_zero(spark):
    e = edges_df(spark, [("A", "B", 100.0, 10), ("A", "C", 50.0, 20)])
    r = feat.decayed_aggregates(e, 100.0, 0.0).first()
    assert (r.decayed_sum, r.decayed_mean, r.decayed_weighted_mean) == (150.0, 75.0, 75.0)
    assert math.isclose(spark.range(1).select(feat.decay_weight(F.lit(-5.0), 0.5)).first()[0], 1.0)
