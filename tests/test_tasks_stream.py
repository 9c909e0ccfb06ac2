"""Sampling, link-prediction invariants, fraud injection, calibration and streaming equality."""
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import evaluate as ev
from ledgerloom.operators import fraud as fr
from ledgerloom.operators import privacy as pv
from ledgerloom.operators import sampling as sm
from ledgerloom.operators import temporal as tp
from tests.conftest import SF01, edges_df


def test_neighbor_sampling_exact_k(spark):
    adj = spark.createDataFrame([("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("e", "f", 4)], "u string, v string, edge int")
    s = sm.sample_neighbors(adj, 2)
    n = {r.node: r["count"] for r in s.groupBy("node").count().collect()}
    assert n == {"a": 2, "e": 2}
    assert {r.neighbor for r in s.where("node = 'e'").collect()} == {"f"}
    assert sm.sample_neighbors(adj, 0).count() == 4


def test_sampling_draws_in_neighbours_and_parallel_edges(spark):
    rows = [("x", "t", 1.0, 1), ("x", "t", 1.0, 2), ("y", "t", 1.0, 3), ("t", "z", 1.0, 4)]
    adj = sm.in_neighbours(edges_df(spark, rows).withColumn("edge_id", F.col("ts")))
    got = [(r.node, r.neighbor, r.edge) for r in sm.sample_neighbors(adj, 3).collect()]
    assert sorted(g for g in got if g[0] == "t") == [("t", "x", 1), ("t", "x", 2), ("t", "y", 3)]
    assert {g[:2] for g in got if g[0] != "t"} == {("z", "t")} and len(got) == 6
    edges, nodes = sm.multi_hop_sample(adj, spark.createDataFrame([("z",)], "node string"), [2, 3])
    assert {(r.hop, r.node, r.neighbor) for r in edges.collect()} == {(1, "z", "t"), (2, "t", "x"), (2, "t", "y")}
    assert [r.node for r in nodes.orderBy("local_index").collect()] == ["z", "t", "x", "y"]


def test_negative_samples_exclude_positives_and_selves(spark):
    nodes = spark.createDataFrame([(1, f"n{i:02d}") for i in range(40)] + [(2, "a"), (2, "b")], "split long, node string")
    pos = spark.createDataFrame([(1, f"n{i:02d}", f"n{i + 1:02d}") for i in range(39)] + [(2, "a", "b")], "split long, src string, dst string")
    want = spark.createDataFrame([(1, 300), (2, 5)], "split long, n_neg long")
    got = [tuple(r) for r in sm.negative_samples(nodes, pos, want).collect()]
    taken = {tuple(r) for r in pos.collect()}
    assert len(got) == len(set(got)) and not taken & set(got) and all(u != v for _, u, v in got)
    assert sum(g[0] == 1 for g in got) == 300 and [g for g in got if g[0] == 2] == [(2, "b", "a")]


def test_link_prediction_invariants(spark):
    import random
    rnd = random.Random(1)
    rows = [(f"a{rnd.randrange(6)}", f"a{rnd.randrange(6)}", 1.0, rnd.randrange(1, 11)) for _ in range(20)]
    e = edges_df(spark, rows).withColumn("ledger", F.col("ts"))
    splits = {r.boundary: r for r in sm.link_prediction_splits(e, "ledger", 2, None or 100).collect()}
    for b, r in splits.items():
        ctx = sum(1 for x in rows if x[3] < b)
        fut = sum(1 for x in rows if b <= x[3] < b + 2)
        assert (r.n_context, r.n_future) == (ctx, fut) and ctx > 0 and fut > 0


def test_fraud_injection_counts(spark):
    base = spark.createDataFrame([("A", "B", 10.0, 1735689600)], "src string, dst string, amount double, ts long")
    aug = fr.inject_fraud(base, sybil=dict(fr.SYBIL, clusters=1, cluster_size=2, tx_per_member=2),
                          wash=dict(fr.WASH, loops=1, loop_size=3, rounds=2))
    c = {r.pattern: r.n for r in fr.injection_summary(aug).collect()}
    assert c == {"original": 1, "sybil_cluster": 4, "wash_trading_loop": 6}
    ts = sorted(r.ts for r in aug.where("synthetic_fraud").collect())
    assert ts == list(range(1735689601, 1735689611))


def test_calibration_degenerate_inputs(spark):
    for ys, ps in [([0, 1] * 50, [0.5] * 100), ([0] * 100, [0.3] * 100), ([1] * 100, [0.9] * 100)]:
        df = spark.createDataFrame([(i, y, p) for i, (y, p) in enumerate(zip(ys, ps))], "id long, y_true int, y_prob double")
        e = ev.calibration_errors(df).first()
        assert all(v is not None and v == v for v in e)
        assert 0.0 <= e.ece <= 1.0 and 0.0 <= e.brier <= 1.0
        assert ev.auc_roc(df).first().auc in (0.0, 0.5) or 0 <= ev.auc_roc(df).first().auc <= 1


def test_auc_matches_pairwise(spark):
    import random
    rnd = random.Random(5)
    data = [(i, rnd.randrange(2), round(rnd.random(), 1)) for i in range(300)]
    df = spark.createDataFrame(data, "id long, y_true int, y_prob double")
    pos = [p for _, y, p in data if y == 1]
    neg = [p for _, y, p in data if y == 0]
    exp = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert ev.auc_roc(df).first().auc == pytest.approx(exp)


def test_uniqueness_closed_form_equals_pairs(spark):
    rows = [(i, (i * 2654435761) % (1 << 16)) for i in range(40)]
    sig = spark.createDataFrame(rows, "w long, signature long")
    got = {r.w: r.uniqueness for r in pv.signature_uniqueness(sig, "w", bits=16).collect()}
    for w, s in rows:
        d = sum(bin(s ^ o).count("1") for x, o in rows if x != w) / (39 * 16)
        assert got[w] == pytest.approx(d)


def test_rolling_snapshot_inclusive_boundaries(spark):
    e = edges_df(spark, [(f"u{i % 5}", f"v{i % 7}", 1.0, 1000 + 10 * i) for i in range(10)])
    snap = tp.rolling_snapshots(e, "20s", "20s")
    per = {r.window_index: r["count"] for r in snap.groupBy("window_index").count().collect()}
    # windows [1000,1020], [1020,1040], ...: boundary rows land in two windows
    assert per[0] == 3 and per[1] == 3
    assert sorted(r.ts for r in snap.where("window_index = 0").collect()) == [1000, 1010, 1020]


def test_stream_batches_equal_single_batch(spark):
    import __spark_entry__ as ent
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    a = sorted(ent.queries()["stream_ingest"](spark, "/root/testdata/sf0.001").collect(), key=key)
    b = sorted(ent.queries()["normalize_with_hops"](spark, "/root/testdata/sf0.001").collect(), key=key)
    assert a == b


def test_entry_smoke(spark):
    import __spark_entry__ as ent
    df = ent.entry(spark)
    assert df.count() > 0 and "asset_entropy" in df.columns


def test_split_accounts_counted_without_expanding_them(spark, monkeypatch):
    import random

    from ledgerloom.operators import sampling as sm
    rnd = random.Random(5)
    name = lambda: rnd.choice([None, *"abcdefg"])
    ledgers = [1, 2, 3, 7, 8, 15, 16, 17, 18, 30]
    rows = [(rnd.choice(ledgers), name(), name()) for _ in range(25)]
    parts, whole = [], sm._to_splits
    monkeypatch.setattr(sm, "_to_splits", lambda r, *a: parts.append(r.columns) or whole(r, *a))
    got = {r.boundary: (r.n_context, r.n_future, r.n_nodes) for r in sm.link_prediction_splits(
        spark.createDataFrame(rows, "ledger long, src string, dst string"), "ledger", 3, 2).collect()}
    seen, want = sorted({r[0] for r in rows}), {}
    for i, b in enumerate(seen[1:], 1):
        ctx = [r for r in rows if r[0] in seen[max(0, i - 2):i]]
        fut = [r for r in rows if b <= r[0] < b + 3]
        want[b] = (len(ctx), len(fut), len({x for r in ctx + fut for x in r[1:]} - {None}))
    assert got == want and parts == [["t", "n"]]


def test_draws_of_negative_samples_are_not_broadcast(spark):
    """The blocks of draws are few small rows; the draws made of them were broadcast (48 MB here)."""
    nodes = spark.createDataFrame([(1, f"n{i:04d}") for i in range(2000)], "split long, node string")
    pos = spark.createDataFrame([(1, "n0000", "n0001")], "split long, src string, dst string")
    want = spark.createDataFrame([(1, 100_000)], "split long, n_neg long")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "16m")
    try:
        got = sm.negative_samples(nodes, pos, want)
        assert got.count() == 100_000 == got.distinct().count()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_negative_samples_keep_the_first_draws(spark):
    """A split that the first draws leave short goes on to the whole budget; what is kept are the first valid draws."""
    import hashlib
    import itertools
    names = {1: [f"n{i}" for i in range(8)], 2: [f"m{i:02d}" for i in range(60)]}
    taken = {1: {("n0", "n1"), ("n3", "n2")}, 2: {("m00", "m01")}}
    want = {1: 50, 2: 40}
    draw = lambda *k: int(hashlib.md5("|".join(map(str, k)).encode()).hexdigest()[:15], 16)
    expected = set()
    for s, ids in names.items():
        valid = {}
        for i in range(10 * want[s]):
            u, v = (ids[draw(42, s, i, side) % len(ids)] for side in (0, 1))
            if u != v and (u, v) not in taken[s]:
                valid.setdefault((u, v), i)
        expected |= {(s, *p) for p in itertools.islice(valid, want[s])}
    got = sm.negative_samples(
        spark.createDataFrame([(s, x) for s, ids in names.items() for x in ids], "split long, node string"),
        spark.createDataFrame([(s, *p) for s, ps in taken.items() for p in ps], "split long, src string, dst string"),
        spark.createDataFrame(list(want.items()), "split long, n_neg long"))
    assert {tuple(r) for r in got.collect()} == expected
