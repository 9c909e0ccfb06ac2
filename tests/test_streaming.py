"""Streaming: resume from the checkpoint (M2), batches published once (A12), statistics, stalls."""
from pyspark.sql import functions as F

from ledgerloom.operators import ingest as ig
from ledgerloom.sources import files as fl
from ledgerloom.sources.adapters import raw_ops
from ledgerloom.streaming import jobs as sj


def _key(r):
    return tuple("" if v is None else str(v) for v in r)


def test_resume_processes_only_new_files(spark):
    r = raw_ops(spark, "/root/testdata/sf0.001").select("seq", F.col("raw").alias("value"))
    landing, table, quarantine, ck = (fl.shared_dir(spark, n) for n in ("t-landing", "t-table", "t-q", "t-ck"))
    r.where("seq < 3000").drop("seq").write.mode("append").text(landing)
    sj.ingest_operations(spark, landing, table, quarantine, ck).awaitTermination()
    first = sj.stream_statistics(spark, table).first()
    r.where("seq >= 3000").drop("seq").unionByName(spark.createDataFrame([("not json",)], "value string")) \
        .write.mode("append").text(landing)
    sj.ingest_operations(spark, landing, table, quarantine, ck).awaitTermination()   # same checkpoint: resume
    both = sj.stream_statistics(spark, table).first()
    n = r.count()
    assert first.processed == r.where("seq < 3000").count() and both.processed == n + 1 and both.batches == 2
    got = sorted(spark.read.parquet(table).select("transaction_hash", "operation_id", "amount").collect(), key=_key)
    exp = sorted(ig.normalize_with_hops(r.withColumnRenamed("value", "raw")).select(
        "transaction_hash", "operation_id", "amount").collect(), key=_key)
    assert got == exp
    assert [x.raw for x in spark.read.parquet(quarantine).collect()] == ["not json"]


def test_more_batches_than_the_progress_list_holds(spark):
    landing, table, quarantine, ck = (fl.shared_dir(spark, n) for n in ("t-landing", "t-table", "t-q", "t-ck"))
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "3")
    try:
        spark.createDataFrame([(f"line {i}",) for i in range(8)], "value string").repartition(8).write.text(landing)
        sj.ingest_operations(spark, landing, table, quarantine, ck, max_files=1).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    assert sj.stream_statistics(spark, table).first().processed == 8
    assert spark.read.parquet(quarantine).count() == 8


def test_duplicate_keys_in_the_first_batch_and_replays(spark):
    table = fl.shared_dir(spark, "t-upsert")
    rows = lambda *r: spark.createDataFrame(list(r), "k string, id int, v double, seq int")
    w = sj.upsert_sink(table, ["k", "id"], ["seq"])
    w(rows(("a", 1, 9.0, 1), ("a", 1, 10.0, 2), ("b", 2, 20.0, 3)), 0)
    assert spark.read.parquet(table).count() == 2
    w(rows(("a", 1, 11.0, 4)), 1)
    w(rows(("a", 1, 99.0, 4)), 1)       # a replayed batch id changes nothing
    got = sorted((r.k, r.v) for r in sj.latest(spark, table, ["k", "id"]).collect())
    assert got == [("a", 11.0), ("b", 20.0)]


def test_crash_before_publishing_leaves_the_table_whole(spark, monkeypatch):
    table = fl.shared_dir(spark, "t-crash")
    one = spark.createDataFrame([("a", 1)], "k string, v int")
    sj.commit_batch(one, table, 0)
    real = sj._path

    def broken(spark, path):
        if "batch_id=1" in path:
            raise RuntimeError("driver lost")
        return real(spark, path)
    monkeypatch.setattr(sj, "_path", lambda s, p: broken(s, p) if p.endswith("batch_id=1") else real(s, p))
    try:
        sj.commit_batch(spark.createDataFrame([("a", 2)], "k string, v int"), table, 1)
    except RuntimeError:
        pass
    monkeypatch.undo()
    assert [r.v for r in sj.latest(spark, table, ["k"]).collect()] == [1]
    sj.commit_batch(spark.createDataFrame([("a", 2)], "k string, v int"), table, 1)
    assert [r.v for r in sj.latest(spark, table, ["k"]).collect()] == [2]


def test_stalls_by_gap(spark):
    rows = [("s", t, i) for i, t in enumerate((0, 100, 1600, 3101, 3101, 9000))] + [("u", 5, 0)]
    got = sj.stalls(spark.createDataFrame(rows, "stream string, ts long, seq int"), "ts", "seq", "stream").collect()
    assert sorted(tuple(r) for r in got) == [("s", 1600, 3100, 3101), ("s", 3101, 4601, 9000)]
