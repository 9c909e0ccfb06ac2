"""Betweenness by source blocks, cycles from halves, similar wallets, ledger log, mirror, sparse vectors
and JSON arrays against brute force."""
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import encoding as enc
from ledgerloom.operators import graph as gr
from ledgerloom.operators import ingest as ig
from ledgerloom.operators import privacy as pv
from ledgerloom.sources import files as fl
from ledgerloom.sources import ledger_log as ll
from tests.conftest import as_dict, edges_df


def random_edges(seed, nodes, count):
    rnd = random.Random(seed)
    return [(f"n{rnd.randrange(nodes)}", f"n{int(nodes * rnd.random() ** 2)}", rnd.random() + .1, i) for i in range(count)]


def test_tiles_equal_rows_of_nodes(spark, monkeypatch):
    rows = random_edges(2, 30, 45) + [("x1", "x2", 1.0, 0), ("x2", "x3", 1.0, 0), ("y", "y", 1.0, 0)]
    e = edges_df(spark, rows)
    nodes = gr.node_table(e)
    run = lambda **how: (as_dict(gr.betweenness_centrality(e, **how), "node", "betweenness"),
                         as_dict(gr.closeness_bitset(e, True, nodes, nodes, **how), "node", "closeness"))
    tiled = run(tile=8, state_rows=200)
    monkeypatch.setattr(gr.tiles, "tiles_are_full", lambda *a: False)
    monkeypatch.setattr(gr.tiles, "dependencies", None)
    plain = run()
    assert tiled[0] == pytest.approx(plain[0]) and tiled[1] == pytest.approx(plain[1])


@pytest.mark.parametrize("lanes,state_rows", [(8, 30), (16, 1 << 20)])
def test_blocks_of_sources_add_up(spark, lanes, state_rows):
    rows = random_edges(1, 26, 40)
    e = edges_df(spark, rows)
    got = as_dict(gr.betweenness_centrality(e, normalized=False, lanes=lanes, state_rows=state_rows), "node", "betweenness")
    near = {}
    for a, b, _, _ in rows:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    nodes = sorted({x for r in rows for x in r[:2]})
    want = dict.fromkeys(nodes, 0.0)

    def paths(s, t):
        """All shortest paths: walks that step one further from s each time."""
        dist, queue = {s: 0}, [s]
        for u in queue:
            for v in near.get(u, ()):
                if v not in dist:
                    dist[v] = dist[u] + 1
                    queue.append(v)
        level = [[s]] if t in dist else []
        while level and level[0][-1] != t and len(level[0]) <= dist[t]:
            level = [p + [v] for p in level for v in near[p[-1]] if dist[v] == len(p)]
            level = [p for p in level if len(p) <= dist[t] or p[-1] == t]
        return level

    for s, t in itertools.permutations(nodes, 2):
        found = paths(s, t)
        for p in found:
            for v in p[1:-1]:
                want[v] += 1 / len(found)
    assert got == pytest.approx(want)
    closeness = as_dict(gr.closeness_bitset(e, True, gr.node_table(e), gr.node_table(e), state_rows), "node", "closeness")
    for s in nodes:
        dist = [len(p[0]) - 1 for t in nodes if t != s for p in [paths(s, t)] if p]
        assert closeness[s] == pytest.approx(len(dist) / sum(dist) if dist else 0.0)


@pytest.mark.parametrize("seed", [2, 3])
def test_cycle_edges_equal_walks(spark, seed):
    rows = random_edges(seed, 30, 70) + [("x", "x", 1.0, 0), (None, "n1", 1.0, 0), ("n1", None, 1.0, 0)]
    pairs = {(a, b) for a, b, _, _ in rows if a and b and a != b}
    for most in (2, 3, 4):
        on = set()
        for a, b in pairs:
            reach = {b}
            for _ in range(most - 1):
                reach = {d for c, d in pairs if c in reach}
                if a in reach:
                    on.add((a, b))
        got = {tuple(r) for r in gr.cycle_edges(edges_df(spark, rows), most).collect()}
        assert got == on
    share = sum(w for a, b, w, _ in rows if (a, b) in on) / sum(w for a, b, w, _ in rows if (a, b) in pairs)
    assert gr.cyclic_flow_ratio(edges_df(spark, rows)).first()[0] == pytest.approx(share)
    assert gr.cyclic_flow_ratio(edges_df(spark, rows).where("false")).first()[0] == 0.0
    with pytest.raises(ValueError):
        gr.cycle_edges(edges_df(spark, rows), 5)


def test_similar_wallets_equal_all_pairs(spark):
    rnd = random.Random(6)
    rows = []
    for i in range(60):
        s = rnd.getrandbits(64)
        rows.append((f"w{i}", s))
        for j in range(rnd.randrange(4)):
            t = s
            for b in rnd.sample(range(64), rnd.choice([0, 1, 11, 12, 13, 14])):
                t ^= 1 << b
            rows.append((f"w{i}_{j}", t))
    rows += [("zero", 0), ("full", 2 ** 64 - 1)]
    signed = [(w, s - (1 << 64) if s >> 63 else s) for w, s in rows]
    sigs = spark.createDataFrame(signed, "wallet string, signature long").repartition(3)
    rep = {s: min(w for w, t in rows if t == s) for _, s in rows}
    links = {(*sorted((rep[s], rep[t])), (s ^ t).bit_count()) for (_, s), (_, t) in itertools.combinations(rows, 2)
             if s != t and (s ^ t).bit_count() <= 12}
    for parts in (4, 8):
        got = [tuple(r) for r in pv.similar_classes(pv.signature_classes(sigs, "wallet"), parts=parts).collect()]
        assert len(got) == len(links) and set(got) == links
    got = {r.wallet: (r.representative, r.n_similar) for r in pv.similar_wallets(sigs, "wallet").collect()}
    assert got == {w: (rep[s], sum(v != w and (s ^ t).bit_count() <= 12 for v, t in rows)) for w, s in rows}
    assert pv.similar_wallets(sigs.where("false"), "wallet").count() == 0


def test_ledger_log_after_a_crash(spark):
    table = fl.shared_dir(spark, "ledger-log")
    payload = spark.createDataFrame([(i, f"p{i}", "x") for i in range(1, 30) if i != 12], "ledger long, body string, status string")
    assert ll.ingest_ledgers(payload, table).count() == 0               # nothing known, no bounds

    def fail(piece):
        if piece == 2:
            raise KeyError("lost")

    with pytest.raises(KeyError):
        ll.ingest_ledgers(payload, table, 1, 15, ledgers_per_commit=5, before_commit=fail)
    assert sorted(r.ledger for r in ll.ingested(spark, table).collect()) == [1, 2, 3, 4, 5]
    status = as_dict(ll.ingest_ledgers(payload, table, 1, 15, ledgers_per_commit=5), "ledger", "status")
    assert status == {i: "skipped" if i <= 5 else "missing" if i == 12 else "processed" for i in range(1, 16)}
    assert as_dict(ll.ingest_ledgers(payload, table), "ledger", "status") == {16: "processed"}
    rows = ll.ingested(spark, table).select("ledger", "body").collect()
    assert sorted(map(tuple, rows)) == [(i, f"p{i}") for i in range(1, 17) if i != 12]
    with pytest.raises(ValueError):
        ll.ingest_ledgers(payload, table, 9, 3)


def test_mirror_tables_and_what_the_checks_find(spark):
    ops = [("t1", 1, "payment", "A", "B", "XLM", 5.0, 10, 1), ("t1", 2, "change_trust", "A", None, "XLM", None, 10, 1),
           ("t2", 3, "claim_claimable_balance", "B", "C", "XLM", 1.0, 20, 2), ("t2", 4, "payment", "B", "B", "XLM", 1.0, 20, 2)]
    norm = spark.createDataFrame(ops, "transaction_hash string, operation_id long, type string, sender string, receiver string, "
                                      "asset string, amount double, ts long, ledger_sequence long")
    tx = spark.createDataFrame([("t1", True, 2, 200, "text", "m")], "hash string, successful boolean, operation_count int, "
                                                                  "fee long, memo_type string, memo string")
    accounts = ig.graph_accounts(norm)
    m = ig.graph_mirror(norm, tx, accounts)
    edges = ig.mirror_table(m, "edges")
    assert {r.external_event_id: r.edge_type for r in edges.collect()} == {"t1:1": "payment", "t1:2": "transaction", "t2:3": "claim"}
    details = {t: ig.mirror_table(m, t) for t in ig.EDGE_TYPES}
    pay = details["payment"].first()
    assert (pay.payment_status, pay.fee_amount, pay.settled_at) == ("settled", 100.0, 10)
    assert details["claim"].first().claim_status == "claimed" and details["transaction"].first().memo == "m"
    assert set(as_dict(ig.mirror_checks(edges, details, accounts), "check", "rows").values()) == {0}
    broken = edges.unionByName(edges.where("edge_type = 'payment'").withColumn("id", F.lit(99).cast("long")).withColumn(
        "destination_account_id", F.col("source_account_id")))
    details["payment"] = details["payment"].unionByName(details["claim"].select(
        "edge_id", "edge_type", F.lit("r").alias("payment_reference"), F.lit("s").alias("payment_status"),
        F.lit(-1.0).alias("fee_amount"), F.lit(1).cast("long").alias("settled_at")))
    found = as_dict(ig.mirror_checks(broken, details, accounts.where("account_address <> 'C'")), "check", "rows")
    assert found == {"edge_without_detail": 1, "detail_without_edge": 0, "edge_with_several_details": 1,
                     "detail_of_other_type": 1, "repeated_external_event": 1, "unknown_edge_type": 0, "edge_to_itself": 1,
                     "unknown_account": 1, "negative_fee": 1}


def test_sparse_one_hot_and_dot(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "zz"), (4, None)], "id long, asset string")
    vocab = enc.asset_vocabulary(spark.createDataFrame([("a",), ("b",), ("c",)], "asset string"))
    x = enc.sparse_one_hot(df, vocab)
    got = {r.id: (r.one_hot["size"], r.one_hot.indices, r.one_hot["values"]) for r in x.collect()}
    assert got == {1: (3, [1], [1.0]), 2: (3, [0], [1.0]), 3: (3, [0], [1.0]), 4: (3, [0], [1.0])}
    weights = spark.createDataFrame([(0, 0.5), (1, 2.0)], "index long, weight double")
    assert as_dict(enc.sparse_dot(x.select("id", "one_hot"), weights), "id", "dot") == {1: 2.0, 2: 0.5, 3: 0.5, 4: 0.5}


@pytest.mark.parametrize("parts", [1, 4])
def test_json_array_over_many_files(spark, parts):
    folder = fl.shared_dir(spark, "array")
    rows = [(str(i), f'h,"[{i}]') for i in range(7)]
    df = spark.createDataFrame(rows, "sequence string, hash string").repartition(parts)
    fl.write_ledger_json(df, folder, "array")
    fs, p = fl._fs(spark, folder)
    names = sorted(f.getPath().getName() for f in fs.listStatus(p) if f.getPath().getName().startswith("part-"))
    text = "".join(open(folder.removeprefix("file:") + "/" + n).read() for n in names)
    assert sorted((r["sequence"], r["hash"]) for r in json.loads(text)) == rows     # one array
    assert fl.json_form(spark, folder) == "array"
    back = fl.read_ledger_json(spark, folder, df.schema)
    assert sorted((r.sequence, r["hash"]) for r in back.collect()) == rows
    fl.write_ledger_json(df, folder, "lines")
    assert fl.json_form(spark, folder) == "lines" and fl.read_ledger_json(spark, folder, df.schema).count() == 7
    fl.write_ledger_json(df.where("false"), folder, "array")
    assert fl.read_ledger_json(spark, folder, df.schema).count() == 0
