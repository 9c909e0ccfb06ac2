"""Betweenness and closeness inside tasks: kernels against plain Brandes, components of all sizes, and what
reaches which path."""
import glob
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import graph as gr
from ledgerloom.operators import inside
from tests.conftest import as_dict, edges_df


def near_of(pairs, nodes):
    near = {v: set() for v in nodes}
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    return near


def brandes(near, sources):
    """(dependency per node, (reached, sum of distances) per source)."""
    total, far = dict.fromkeys(near, 0.0), {}
    for s in sources:
        dist, paths, queue = {s: 0}, {s: 1}, [s]
        for u in queue:
            for v in near[u]:
                if v not in dist:
                    dist[v], paths[v] = dist[u] + 1, 0
                    queue.append(v)
                if dist[v] == dist[u] + 1:
                    paths[v] += paths[u]
        below = dict.fromkeys(queue, 0.0)
        for v in reversed(queue):
            for u in near[v]:
                if dist[u] == dist[v] - 1:
                    below[u] += paths[u] / paths[v] * (1 + below[v])
            if v != s:
                total[v] += below[v]
        far[s] = (len(dist) - 1, sum(dist.values()))
    return total, far


def chains(seed):
    """A dense core whose nodes end in chains, a star with a hub of 200 neighbours, a ring and single pairs."""
    rnd = random.Random(seed)
    pairs = [(rnd.randrange(20), rnd.randrange(20)) for _ in range(90)]
    pairs += [(i + 20 * k, i + 20 * (k + 1)) for i in range(20) for k in range(4)]
    pairs += [(200, 201 + i) for i in range(200)] + [(201 + i, 402 + i // 20) for i in range(200)]
    pairs += [(500 + i, 500 + (i + 1) % 31) for i in range(31)] + [(600 + 2 * i, 601 + 2 * i) for i in range(40)]
    return pairs


@pytest.mark.parametrize("cells,lanes", [(1 << 21, 64), (1 << 12, 3)])
def test_kernels_equal_brandes(monkeypatch, cells, lanes):
    monkeypatch.setattr(inside, "_CELLS", cells)
    monkeypatch.setattr(inside, "_LANES", lanes)
    pairs = sorted({(min(p), max(p)) for p in chains(1) if p[0] != p[1]})
    nids = np.unique(np.array(pairs))
    a, b = (np.searchsorted(nids, np.array(pairs)[:, i]) for i in (0, 1))
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    first = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=len(nids)))])
    g = inside.Adjacency(first, b[np.lexsort((b, a))].astype(np.int32))
    order = g.by_distance()
    assert sorted(order) == list(range(len(nids)))
    for sources in (order, order[::7]):
        total, far = brandes(near_of(pairs, nids.tolist()), nids[sources].tolist())
        assert inside.dependencies_of(g, sources) == pytest.approx([total[v] for v in nids.tolist()])
        reached, away = inside.distances_of(g, sources)
        assert list(zip(reached, away)) == [far[v] for v in nids[sources].tolist()]


@pytest.mark.parametrize("local_pairs", [20, 1 << 22])
def test_components_of_all_sizes_add_up(spark, local_pairs):
    """Some or all of the components run inside tasks, the others do not; loops and null ends do not count."""
    rnd = random.Random(2)
    pairs = [(rnd.randrange(9), rnd.randrange(9)) for _ in range(25)] + [(20, 21), (21, 22), (22, 20), (22, 23), (30, 31), (32, 33)]
    rows = [(f"n{a:04d}", f"n{b:04d}", 1.0, 0) for a, b in pairs]
    e = edges_df(spark, rows + [("z", "z", 1.0, 0), (None, "n0001", 1.0, 0), ("n0001", None, 1.0, 0)])
    nodes = sorted({x for r in rows for x in r[:2]} | {"z"})
    near = near_of([r[:2] for r in rows], nodes)
    total, far = brandes(near, nodes)
    got = as_dict(gr.betweenness_centrality(e, normalized=False, local_pairs=local_pairs, lanes=16), "node", "betweenness")
    assert got == pytest.approx(total)
    table = gr.node_table(e)
    got = as_dict(gr.closeness_bitset(e, True, table, table, local_pairs=local_pairs), "node", "closeness")
    assert got == pytest.approx({v: n / d if d else 0.0 for v, (n, d) in far.items()})
    some = gr.closeness_centrality(e, True, sample_size=9).collect()
    assert len(some) == 9 and all(r.closeness == pytest.approx(got[r.node]) for r in some)


def test_dense_graph_runs_inside_tasks(spark, monkeypatch):
    """A graph that a task holds makes no rounds of sources (16,000 sources made 125 of them)."""
    rnd = random.Random(3)
    rows = [(f"c{rnd.randrange(300)}", f"s{rnd.randrange(30)}", 1.0, 0) for _ in range(2000)]
    for name in ("source_blocks", "_source_rounds"):
        monkeypatch.setattr(gr, name, None)
    e = edges_df(spark, rows)
    nodes = sorted({x for r in rows for x in r[:2]})
    total, far = brandes(near_of([r[:2] for r in rows], nodes), nodes)
    assert as_dict(gr.betweenness_centrality(e, normalized=False), "node", "betweenness") == pytest.approx(total)
    want = {v: (len(nodes) - 1) / d if n == len(nodes) - 1 else 0.0 for v, (n, d) in far.items()}
    assert as_dict(gr.closeness_centrality(e), "node", "closeness") == pytest.approx(want)


def test_no_edges(spark):
    e = edges_df(spark, [("z", "z", 1.0, 0), (None, "a", 1.0, 0)])
    assert [tuple(r) for r in gr.betweenness_centrality(e).collect()] == [("z", 0.0)]
    assert [tuple(r) for r in gr.closeness_centrality(e, True).collect()] == [("z", 0.0)]
    none = e.where(F.lit(False))
    assert gr.betweenness_centrality(none).count() == 0 and gr.closeness_centrality(none).count() == 0


def test_long_chains_make_no_rounds_of_levels(spark):
    """Each level of a breadth-first pass wrote its state before: a chain of n nodes n levels of every round."""
    n, sc = 120, spark.sparkContext
    e = edges_df(spark, [(f"n{i:03d}", f"n{i + 1:03d}", 1.0, 0) for i in range(n - 1)])
    jobs = {}
    for name, step in (("betweenness", lambda: gr.betweenness_centrality(e, normalized=False)), ("closeness", lambda: gr.closeness_centrality(e, True))):
        sc.setJobGroup(name, name)
        try:
            got = as_dict(step(), "node", name)
        finally:
            sc.setJobGroup("", "")
        jobs[name] = len(sc.statusTracker().getJobIdsForGroup(name))
        far = lambda i: i * (i + 1) / 2 + (n - 1 - i) * (n - i) / 2
        want = {f"n{i:03d}": 2.0 * i * (n - 1 - i) if name == "betweenness" else (n - 1) / far(i) for i in range(n)}
        assert got == pytest.approx(want)
    print(jobs)
    assert max(jobs.values()) < 5 * n, jobs


def test_steps_over_all_edges_leave_no_shuffle_files(spark):
    rnd = random.Random(4)
    e = edges_df(spark, [(f"c{rnd.randrange(200)}", f"s{rnd.randrange(40)}", 1.0, 0) for _ in range(1500)]).repartition(6, "src")
    known = shuffle_files(spark)
    nodes, pairs = gr.numbered_graph(e)
    of = gr._numbered_components(nodes.select(F.col("nid").alias("node")), pairs)
    for _ in range(50):         # executors remove them a moment later
        left = shuffle_files(spark) - known
        if len(left) <= 8:
            break
        time.sleep(0.1)
    assert of.select("component").distinct().count() == 1
    assert len(left) <= 8, len(left)         # those of the numbers of the nodes


def shuffle_files(spark):
    base = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in base for f in glob.glob(f"{d}/*/shuffle_*.data")}
