"""Steps whose cost grew faster than their input."""
import itertools
import random
from collections import Counter

import numpy as np

from ledgerloom.operators import graph as gr
from ledgerloom.operators import privacy as pv
from ledgerloom.streaming import records as sr
from tests.conftest import as_dict


def test_near_pairs_over_chunks_equal_all_pairs():
    rnd = np.random.default_rng(4)
    a = rnd.integers(0, 2 ** 64, 40, np.uint64, endpoint=False)
    a = np.concatenate([a, a[::3] ^ np.uint64(1 << 63), a[::5] ^ np.uint64(0xFFF), a[::7] ^ np.uint64(0x1FFF)])
    b = np.concatenate([rnd.integers(0, 2 ** 64, 9000, np.uint64, endpoint=False), a[:10] ^ np.uint64(7)])
    near = lambda x, y: (int(x) ^ int(y)).bit_count() <= 12
    inside = {(i, j) for (i, x), (j, y) in itertools.combinations(enumerate(a), 2) if near(x, y)}
    assert set(zip(*map(np.ndarray.tolist, pv._near_pairs(a, None, 12)))) == inside and len(inside) > 20
    across = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if near(x, y)}
    assert set(zip(*map(np.ndarray.tolist, pv._near_pairs(a, b, 12)))) == across and len(across) >= 10


def test_similar_classes_of_numbered_wallets_move_no_row_per_mask(spark):
    sigs = spark.createDataFrame([(i, -1 << (i % 50)) for i in range(200)] + [(500, None), (None, 5)], "wallet long, signature long")
    links = pv.similar_classes(pv.signature_classes(sigs, "wallet"), parts=5)
    assert "Generate explode(transform" not in links._jdf.queryExecution().toString()
    got = sorted(map(tuple, links.collect()))
    assert got == [(i, j, j - i) for i in range(50) for j in range(i + 1, min(i + 13, 50))]


def _edges_read_once(spark, rows):
    """edges, and how often a row of them was made"""
    made = spark.sparkContext.accumulator(0)

    def count(parts):
        for p in parts:
            made.add(len(p))
            yield p
    e = spark.createDataFrame(rows, "src string, dst string")
    return e.mapInPandas(count, e.schema), made


def test_components_and_labels_read_the_edges_once(spark):
    rnd = random.Random(3)
    rows = [(f"n{rnd.randrange(40)}", f"n{rnd.randrange(40)}") for _ in range(45)]
    rows += [("x10", "x9"), ("x9", "x8"), ("solo", "solo"), (None, "n1"), ("n2", None)]
    near = {}
    for a, b in rows:
        if a is not None and b is not None:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    near = {n: m - {n} for n, m in near.items()}
    root = {n: n for n in near}
    for _ in near:
        root = {n: min([root[n]] + [root[m] for m in near[n]]) for n in near}
    label = {n: n for n in near}
    for _ in range(5):
        count = {n: Counter(label[m] for m in near[n]) for n in near}
        label = {n: min(count[n], key=lambda x: (-count[n][x], x)) if near[n] else label[n] for n in near}
    for step, column, want in ((gr.weak_components, "component", root), (gr.label_propagation, "label", label)):
        e, made = _edges_read_once(spark, rows)
        assert as_dict(step(e), "node", column) == want
        assert made.value == len(rows)
    e, made = _edges_read_once(spark, rows)
    got = as_dict(gr.betweenness_centrality(e, sample_size=2), "node", "betweenness")
    assert set(got) == set(near) and made.value == len(rows)


def test_pairs_come_once_and_mirrored(spark):
    e = spark.createDataFrame([("b", "a"), ("a", "b"), ("a", "b"), ("c", "c"), (None, "a")], "src string, dst string")
    nodes, pairs = gr.numbered_graph(e)
    assert as_dict(nodes, "node", "nid") == {"a": 0, "b": 1, "c": 2} and [tuple(r) for r in pairs.collect()] == [(0, 1)]
    assert sorted(map(tuple, gr.undirected_adjacency(e).collect())) == [("a", "b"), ("b", "a")]
    assert sorted(map(tuple, gr.undirected_adjacency(e, True).collect())) == [("a", "b"), ("b", "a"), ("c", "c")]


def test_operations_of_a_stream_are_parsed_beside_their_text(spark):
    raw = spark.createDataFrame([('{"id":"1","type":"payment"}',), ('{"id":"01","type":"payment"}',), ('{"id":"x"}',)], "raw string")
    out = sr._operations(raw)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.id, r.raw) for r in out.collect()) == [(1, '{"id":"01","type":"payment"}'), (1, '{"id":"1","type":"payment"}')]


def test_cycles_and_cliques_read_the_edges_once(spark):
    rows = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "b"), ("a", "c"), ("a", "d"), ("e", "a"), (None, "a"), ("a", "a")]
    e, made = _edges_read_once(spark, rows)
    got = {tuple(r) for r in gr.cycle_edges(e).collect()}
    assert got == {("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "b"), ("a", "c"), ("a", "d")} and made.value == len(rows)
    for step, want in ((gr.triangles, ["abc", "abd", "acd", "bcd"]), (gr.four_cliques, ["abcd"])):
        e, made = _edges_read_once(spark, rows)
        assert sorted("".join(sorted(r)) for r in step(e).collect()) == want and made.value == len(rows)
        assert step(e, names=False).count() == len(want)
