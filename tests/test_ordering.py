"""Distributed ordering helpers equal their single-partition definitions."""
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.plans.ordering import exact_percentiles, windowed, with_cumulative_sums, with_global_rank
from tests.conftest import SF01


def test_global_rank_equals_row_number(spark):
    ev = spark.read.parquet(f"{SF01}/events.parquet").select("event_id", "ts", "user_id")
    r = with_global_rank(ev, ["user_id", "ts", "event_id"], "_g", num_partitions=7)
    c = r.withColumn("rn", F.row_number().over(Window.orderBy("user_id", "ts", "event_id")) - 1)
    assert c.where("rn != _g").count() == 0


def test_windowed_tiny_chunks_equal_plain_window(spark):
    ev = spark.read.parquet(f"{SF01}/events.parquet").select("event_id", "ts", "user_id", "value")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    exp = ev.select("event_id", F.sum("value").over(w.rowsBetween(-3, 2)).alias("s"), F.lag("value").over(w).alias("p"))
    got = windowed(ev, ["user_id"], ["ts", "event_id"], 3, 2,
                   lambda x: [F.sum("value").over(x.rowsBetween(-3, 2)).alias("s"), F.lag("value").over(x).alias("p")],
                   chunk_rows=7).select("event_id", "s", "p")
    diff = exp.alias("a").join(got.alias("b"), "event_id").where(
        (F.abs(F.col("a.s") - F.col("b.s")) > 1e-9) | ~F.col("a.p").eqNullSafe(F.col("b.p")))
    assert got.count() == ev.count() and diff.count() == 0


def test_cumulative_sums_partitioned(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, -3), ("b", 1, 2), ("a", 3, 4), ("b", 2, 1)], "k string, t int, v int")
    out = {(r.k, r.t): r.cum_v for r in with_cumulative_sums(df, ["k", "t"], ["v"], partition_cols=["k"], num_partitions=3).collect()}
    assert out == {("a", 1): 5, ("a", 2): 2, ("a", 3): 6, ("b", 1): 2, ("b", 2): 3}


def test_exact_percentiles_match_pandas(spark):
    import numpy as np
    vals = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    r = exact_percentiles(df, "x", {"m": 0.5, "p95": 0.95}, num_partitions=3).first()
    assert r.m == pytest.approx(np.percentile(vals, 50)) and r.p95 == pytest.approx(np.percentile(vals, 95))
    lo = exact_percentiles(df, "x", {"m": 0.5}, interpolation="lower").first().m
    assert lo == sorted(vals)[(len(vals) - 1) // 2]


@pytest.mark.parametrize("parts", [1, 8])
def test_partition_count_invariance(spark, parts):
    import __spark_entry__ as ent
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        rows = sorted(ent.queries()["node_features"](spark, SF01).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    base = sorted(ent.queries()["node_features"](spark, SF01).collect())
    assert rows == base


def test_exact_percentiles_empty_input_gives_null_row(spark):
    df = spark.createDataFrame([], "x double")
    rows = exact_percentiles(df, "x", {"m": 0.5, "p9": 0.9}).collect()
    assert len(rows) == 1 and rows[0].m is None and rows[0].p9 is None


def test_range_partitions_over_a_checkpointed_join_follow_its_rows(spark):
    from ledgerloom.plans.ordering import _num_partitions
    from ledgerloom.session import cut_lineage
    a = spark.range(20000).selectExpr("id as k", "repeat('v', 20) as s")
    pairs = cut_lineage(a.join(a.select("k", F.col("s").alias("t")), "k").join(a.select("k", F.col("s").alias("u")), "k"))
    joined = pairs.join(a.select("k", F.col("s").alias("w")), "k").select("k", "w")
    assert _num_partitions(joined, None) <= 2 * spark.sparkContext.defaultParallelism
    assert with_global_rank(joined, ["k"], "r").where("r = k").count() == 20000
