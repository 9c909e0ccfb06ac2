"""Four-kind ingest (replay, crash, quarantine, statistics) and alerts by timers against brute force."""
import json
import random

import pytest

from ledgerloom.sources import files as fl
from ledgerloom.streaming import alerts as sa
from ledgerloom.streaming import jobs as sj
from ledgerloom.streaming import records as sr


def line(stream, **data):
    return json.dumps({"stream": stream, "data": data})


def land(spark, folder, lines):
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(folder)


FIRST = [
    line("ledgers", sequence=5, hash="l5", closed_at="2024-01-01T00:00:10Z", operation_count="2", paging_token="9"),
    line("transactions", hash="t1", ledger=5, source_account="A", created_at="2024-01-01T00:00:05Z", fee_charged="100",
         operation_count="1", successful="true", paging_token="10"),
    line("transactions", hash="t2", ledger=6, source_account="B", created_at="2024-01-01T00:00:20Z", fee_charged="200",
         operation_count="1", successful="false", paging_token="100"),
    line("operations", id="1", type="payment", transaction_hash="t1", source_account="A", to="B", amount="1.5",
         asset_type="native", created_at="2024-01-01T00:00:05Z", paging_token="11"),
    line("effects", id="7", account="B", type="account_credited", amount="1.5", asset_type="native",
         created_at="2024-01-01T00:00:05Z"),
    "no json", line("offers", id="3"), line("operations", type="payment"), '{"stream":"ledgers"}',
]
SECOND = [
    line("operations", id="1", type="payment", transaction_hash="t1", source_account="A", to="B", amount="2.5",
         asset_type="native", created_at="2024-01-01T00:00:05Z", paging_token="11"),
    line("ledgers", sequence=6, hash="l6", closed_at="2024-01-01T00:00:50Z", paging_token="101"),
]


@pytest.fixture()
def places(spark):
    return [fl.shared_dir(spark, n) for n in ("rec-landing", "rec-table", "rec-ck")]


def run(spark, places, **how):
    landing, table, ck = places
    with sj.state_partitions(spark, 2):
        sr.ingest_records(spark, landing, table, ck, **how).awaitTermination()


def state(spark, table):
    amounts = {r.id: r.amount for r in sr.current(spark, table, "operations").collect()}
    ledgers = {r.sequence: r.hash for r in sr.current_ledgers(spark, table).collect()}
    return amounts, ledgers


def test_four_kinds_upsert_stubs_and_statistics(spark, places):
    landing, table, _ = places
    land(spark, landing, FIRST)
    run(spark, places)
    assert state(spark, table) == ({1: 1.5}, {5: "l5", 6: None})        # ledger 6 is a stub of t2
    assert sr.current(spark, table, "effects").first().account == "B"
    assert {r.hash: r.successful for r in sr.current(spark, table, "transactions").collect()} == {"t1": True, "t2": False}
    bad = {r.quarantine for r in sr.committed(spark, table).where("kind = 'quarantine'").collect()}
    assert bad == {FIRST[5], FIRST[6], FIRST[7], FIRST[8]}
    land(spark, landing, SECOND)
    run(spark, places)
    assert state(spark, table) == ({1: 2.5}, {5: "l5", 6: "l6"})
    s = sr.ingest_statistics(spark, table).first()
    assert (s.processed, s.quarantined, s.batches, s.last_cursor) == (11, 4, 2, "101")
    assert s.records_per_sec == pytest.approx(11 / 45)
    hops = sr.current_transfers(spark, table).collect()
    assert [(h.sender, h.receiver, h.asset, h.amount) for h in hops] == [("A", "B", "XLM", 2.5)]


def test_crash_before_commit_shows_nothing_and_is_repeated_once(spark, places):
    landing, table, _ = places
    land(spark, landing, FIRST)
    run(spark, places)
    land(spark, landing, SECOND)

    def fail(batch_id):
        raise RuntimeError("lost here")

    with pytest.raises(Exception, match="lost here"):
        run(spark, places, before_commit=fail)
    assert state(spark, table) == ({1: 1.5}, {5: "l5", 6: None})        # written, but not committed
    run(spark, places)
    assert state(spark, table) == ({1: 2.5}, {5: "l5", 6: "l6"})
    assert sr.committed(spark, table).where("kind = 'operations'").count() == 2     # one per batch, none doubled
    assert sr.ingest_statistics(spark, table).first().processed == 11


def test_listener_reports_the_same_as_the_commits(spark, places):
    landing, table, _ = places
    progress = sr.IngestProgress()
    spark.streams.addListener(progress)
    try:
        land(spark, landing, FIRST)
        run(spark, places)
        land(spark, landing, SECOND)
        run(spark, places)
        spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty(20_000)
        deadline = 50
        while sum(s["processed"] for s in progress.stats.values()) < 11 and deadline:
            deadline -= 1
            __import__("time").sleep(0.2)
    finally:
        spark.streams.removeListener(progress)
    one = next(iter(progress.stats.values()))
    kept = sr.ingest_statistics(spark, table).first()
    assert (one["processed"], one["batches"], one["cursor"]) == (kept.processed, kept.batches, kept.last_cursor)
    assert one["records_per_sec"] > 0


def py_alerts(rows, limit, upto):
    out = set()
    for s in {r[0] for r in rows}:
        ts = sorted({t for k, t, _ in rows if k == s})
        for t, nxt in zip(ts, ts[1:] + [None]):
            if t + 1500 <= upto and (nxt is None or nxt > t + 1500):
                out.add((s, "stalled", t + 1500, t))
        bad = [t for k, t, e in rows if k == s and e]
        over = lambda at: sum(at - 300 <= t < at for t in bad) > limit * 300
        for at in {t // 60 * 60 + 60 * k for t in bad for k in range(1, 6)}:
            if at <= upto and all(over(at - 60 * k) for k in range(3)):
                out.add((s, "error_rate", at, None))
    return out


def test_alert_stream_equals_brute_force_and_sees_silence(spark):
    rnd = random.Random(4)
    rows, now = [], 1_700_000_000
    for _ in range(160):
        now += rnd.choice([5, 20, 40, 90, 400, 1400, 1600, 2400])
        rows.append(("a" if now < 1_700_040_000 else "b", now, rnd.random() < 0.6))     # stream a goes silent
    landing, out, ck = (fl.shared_dir(spark, n) for n in ("al-landing", "al-out", "al-ck"))
    cut = [rows[i:i + 54] for i in range(0, len(rows), 54)]
    with sj.state_partitions(spark, 2), sa.rocksdb_state(spark):
        for part in cut:
            rnd.shuffle(part)
            land(spark, landing, [json.dumps({"stream_type": k, "ts": t, "is_error": e}) for k, t, e in part])
            s = spark.readStream.schema("stream_type string, ts long, is_error boolean").json(landing)
            sa.alert_stream(s, limit=0.004).writeStream.format("parquet").option("path", out).option(
                "checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(out).select("stream_type", "alert", "at", "last_record").collect()]
    want = py_alerts(rows, 0.004, max(t for _, t, _ in rows) // 60 * 60 - 60)
    assert len(got) == len(set(got)) and set(got) == want
    last_a = max(t for k, t, _ in rows if k == "a")
    assert ("a", "stalled", last_a + 1500, last_a) in want and any(r[1] == "error_rate" for r in want)


def test_open_minutes_keep_little():
    m = sa.OpenMinutes(None, 0.1)
    for t in range(0, 60_000, 60):
        m.add(t, t, t + 59, 1)
        m.alerts(t)
    assert len(m.minutes) < 40 and sa.OpenMinutes(m.dump(), 0.1).minutes == m.minutes


def test_texts_of_a_line_are_parsed_once_and_partitions_written_without_a_sort(spark, places):
    landing, table, _ = places
    land(spark, landing, FIRST)
    decoded = sr.decode(spark.read.text(landing))
    plan = decoded._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and "get_json_object" not in plan
    got = {(r.kind, r.key, r.event_time, r.cursor) for r in decoded.collect()}
    assert ("ledgers", "5", "2024-01-01T00:00:10Z", "9") in got
    assert ("effects", "7", "2024-01-01T00:00:05Z", None) in got
    assert sum(r.kind == "quarantine" for r in decoded.collect()) == 4
    run(spark, places)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", "0") == "0"
