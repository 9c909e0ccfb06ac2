"""Shuffle files left on the disks while the join goes on, and the packed winnowing of op9."""
import glob
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import ngram_join, suffix_dedup
from ledgerloom.llm.textblocks import place_of, run_least
from ledgerloom.operators import graph


#: shuffle files of a step over 24 partitions
MOST = 150


def shuffle_files(spark):
    base = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in base for f in glob.glob(f"{d}/*/shuffle_*.data")}


def test_the_rounds_of_the_join_leave_no_shuffle_files_behind(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[k:k + 60] + ([f"x{k}"] if c else [])) for k in range(0, 300, 30) for c in (0, 1)]
    left, known, cut = [], shuffle_files(spark), ngram_join.cut_lineage

    def watched(df):
        # files of earlier steps: what the cleaner was asked to remove may take a moment
        for _ in range(20):
            before = len(shuffle_files(spark) - known)
            if before <= MOST:
                break
            time.sleep(0.1)
        left.append(before)
        return cut(df)

    monkeypatch.setattr(ngram_join, "cut_lineage", watched)
    monkeypatch.setattr(graph, "cut_lineage", watched)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    for k, v in zip(old, ("24", "false")):
        spark.conf.set(k, v)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    try:
        out = {r.doc_id: r.component_id for r in ngram_join.link_documents(docs).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert out == {i: i - i % 2 for i in range(len(texts))}
    assert len(left) > 8 and max(left) <= MOST, left


def test_a_kept_step_leaves_no_shuffle_files_though_its_plan_is_still_held(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "free_shuffles", lambda spark: None)
    df = spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count()
    known, setting = shuffle_files(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(setting, None)
    out = ngram_join._kept(df)
    for _ in range(50):         # executors remove them a moment later
        if not shuffle_files(spark) - known:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - known
    assert spark.conf.get(setting, None) == old
    assert sorted(map(tuple, out.collect())) == sorted((k, len(range(k, 1000, 7))) for k in range(7))


def test_a_set_goes_on_only_if_all_but_d_of_its_keys_recur():
    bands, find = ngram_join.Bands(80), ngram_join._find(5, 80)
    pdf = pd.DataFrame({"doc_id": [1], "text": [" ".join(f"w{i}" for i in range(204))], "block": [0]})
    s, = ngram_join.block_sets(pdf, 5)
    (g, keys, _), (h, others, _) = ngram_join.band_keys(s, bands)
    least = len(keys) - bands.limit(g)
    assert least > 1 and not set(keys.tolist()) & set(others.tolist())
    for n, kinds in ((0, [0]), (1, [0]), (least - 1, [0]), (least, [0, 1, 2]), (len(keys), [0, 1, 2])):
        back = pd.DataFrame({"block": [0], "keys": [np.sort(keys)[:n].tobytes()]})
        found = find(pdf, back)
        assert found["kind"].tolist() == kinds
        assert [len(k) // 8 for k in found["keys"][1:2]] == [n] * (len(kinds) > 1)


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_all_but_d_of_their_keys(percent):
    rnd, bands, linked = np.random.default_rng(percent), ngram_join.Bands(percent), 0
    fresh = lambda n: rnd.integers(0, 2 ** 64, n, dtype=np.uint64)
    for n in [*range(2, 60), 100, 400, 1500] * 6:
        a = np.unique(fresh(n))
        drop = int(rnd.integers(0, n * (100 - percent) // 100 + 2))
        c = np.unique(np.concatenate([a[drop // 2:], fresh(int(rnd.integers(0, drop + 1)))]))
        both = len(np.intersect1d(a, c))
        if not len(np.setxor1d(a, c)) or 100 * both < percent * (len(a) + len(c) - both):
            continue
        linked += 1
        of_a, of_c = ({g: set(k.tolist()) for g, k, _ in ngram_join.band_keys(s, bands)} for s in (a, c))
        met = [g for g in of_a.keys() & of_c.keys()
               if all(len(of_a[g] & of_c[g]) >= max(1, len(x[g]) - bands.limit(g)) for x in (of_a, of_c))]
        assert met, (n, len(a), len(c))
    assert linked > 40


def test_packed_minima_are_the_right_most_of_each_run():
    rng = np.random.default_rng(1)
    for n in (1, 5, 300):
        for width in (1, 4, 27):
            h = rng.integers(0, 2 ** 64, n, dtype=np.uint64)
            h[rng.integers(0, n, n // 2)] = h[0]
            upper = (h >> np.uint64(32)).tolist()
            want = [min(range(i, i + width), key=lambda j: (upper[j], -j)) for i in range(n - width + 1)]
            if want:
                assert place_of(run_least(h, width)).tolist() == want


def test_samples_cover_each_start_once_whatever_the_slices(monkeypatch):
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("ab "), n)) for n in (0, 1, 49, 50, 51, 200, 0, 700, 90)]
    pdf = pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "block": 0})
    seen = []
    for size in (1 << 17, 100):
        monkeypatch.setattr(suffix_dedup, "SLICE", size)
        s = suffix_dedup.Samples(pdf, 50)
        seen.append((s.lo.tolist(), s.hi.tolist(), s.gram.tolist(), s.name.tolist(), s.doc.tolist()))
    assert seen[0] == seen[1]
    starts = [x for a, b in zip(s.lo, s.hi) for x in range(a, b + 1)]
    assert starts == [s.first[t] + i for t, text in enumerate(texts) for i in range(len(text) - 49)]


def test_strings_are_compared_in_words_of_eight_bytes():
    text = np.frombuffer(b"abcabdabcabcabdabc", np.uint8)
    for length in (2, 3, 8, 9):
        at = np.arange(len(text) - length + 1)
        want = [text[i:i + length].tobytes() != text[i + 1:i + 1 + length].tobytes() for i in at[:-1]]
        assert suffix_dedup._differ(text, at, length).tolist() == want
    starts = np.array([0, 6, 9, 15])
    found = suffix_dedup.smaller_elsewhere(text, starts, np.array([3, 2, 2, 1]), 3)
    assert found.tolist() == [True, True, True, False]
