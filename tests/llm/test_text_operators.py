"""Passage, suffix, join, decontamination and packing operators against brute force."""
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import decontam, ngram_join, packing, phrases, suffix_dedup
from ledgerloom.llm.phrases import blocks_of
from ledgerloom.llm.queries import tokenizer_path
from ledgerloom.llm.textblocks import as_bytes, cover, minima, run_argmin, word_windows, words_of

SCHEMA = "doc_id long, text string, block string, name string"
WORDS = ["ab", "c", "déf", "ghi", "jk,", "Lm", "x" * 9, "日本"]


def corpus(seed: int, size: int) -> list[tuple]:
    """Random texts, shared passages, exact and near copies, repeated rows and odd rows."""
    rnd = random.Random(seed)
    text = lambda n: " ".join(rnd.choice(WORDS) + str(rnd.randrange(40)) for _ in range(n))
    shared = [text(45), text(80), text(34), text(36)]
    rows = []
    for i in range(size):
        t = text(rnd.randrange(0, 90))
        if rnd.random() < 0.5:
            t = f"{t} {rnd.choice(shared)}\t{text(rnd.randrange(30))}"
        if rnd.random() < 0.3 and rows:
            w = (rnd.choice(rows)[1] or "").split(" ")
            if len(w) > 4 and rnd.random() < 0.6:
                w[rnd.randrange(len(w))] = "changed"
            t = " ".join(w)
        rows.append((i * 3 + 1, t))
    rows += [(5000, None), (5001, ""), (5002, " \n\t "), (5003, "one"), (5004, "one  two"), (None, shared[0]),
             (5005, text(3000) + " " + shared[1]), (5006, "ONE two"), rows[0], rows[1]]
    rnd.shuffle(rows)
    return [(k, t, "clash", "clash") for k, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus(5, 90)
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_key(rows):
    return sorted((tuple(-1 if v is None else v for v in r) for r in rows), key=repr)


def test_words_and_windows():
    texts = as_bytes(["a  b\tc\x0bd", None, "", "é x"])
    w = words_of(texts)
    assert [bytes(w.data[a:b]).decode() for a, b in zip(w.start, w.end)] == ["a", "b", "c", "d", "é", "x"]
    assert w.first.tolist() == [0, 4, 4, 4, 6]
    h, inside = word_windows(w, 2)
    assert inside.tolist() == [True, True, True, False, True, False]
    assert words_of([b"A b"], lower=True).hash.tolist() == words_of([b"a b"]).hash.tolist()
    assert len(set(words_of([b"ab ba abc b a"]).hash.tolist())) == 5


def test_minima_and_cover():
    rnd = np.random.default_rng(0)
    for width in (1, 2, 5, 8):
        h = rnd.integers(0, 9, 60).astype(np.uint64)
        got = run_argmin(h, width)
        for i, p in enumerate(got):
            run = h[i:i + width].tolist()
            assert p == i + max(j for j, v in enumerate(run) if v == min(run))
        seg = np.repeat([0, 1], 30)
        want = {int(got[i]) for i in range(61 - width) if i + width <= 60 and seg[i] == seg[min(59, i + width - 1)]}
        assert set(np.flatnonzero(minima(h, seg, width))) == want
    assert cover(6, np.array([1, 2]), 3).tolist() == [False, True, True, True, True, False]


@pytest.mark.parametrize("block_bytes", [1 << 11, 1 << 22])
def test_passages_equal_brute_force(spark, docs, block_bytes):
    rows, df = docs
    size, seen = 35, {}
    texts = [(k, (t or "").encode().split()) for k, t, *_ in rows]
    for _, w in texts:
        for i in range(len(w) - size + 1):
            seen[tuple(w[i:i + size])] = seen.get(tuple(w[i:i + size]), 0) + 1
    want = []
    for k, w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i:i + size])] > 1:
                gone[i:i + size] = [True] * size
        want.append((k, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    got = [(r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), r.kept)
           for r in phrases.remove_passages(df, block_bytes=block_bytes).collect()]
    assert by_key(got) == by_key(want)
    assert sum(w[2] for w in want) > 500


def test_suffix_order_sorts_suffixes():
    rnd = np.random.default_rng(2)
    for n in [*range(0, 14), 50, 200]:
        for letters in (1, 2, 5):
            t = rnd.integers(1, letters + 1, n)
            assert suffix_dedup.suffix_order(t, 10 ** 6).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())
            for depth in (2, 7, 30):
                heads = [t[i:i + depth].tolist() for i in suffix_dedup.suffix_order(t, depth)]
                assert heads == sorted(heads)


@pytest.mark.parametrize("block_bytes", [1 << 11, 1 << 22])
def test_suffix_dedup_equals_brute_force(spark, docs, block_bytes):
    rows, df = docs
    size, first = 50, {}
    order = lambda k: 10 ** 9 if k is None else k
    texts = [(k, (t or "").encode()) for k, t, *_ in rows]
    for k, b in texts:
        for i in range(len(b) - size + 1):
            s = b[i:i + size]
            first[s] = min(first.get(s, 10 ** 9), order(k))
    want = []
    for k, b in texts:
        gone = [False] * len(b)
        for i in range(len(b) - size + 1):
            if first[b[i:i + size]] < order(k):
                gone[i:i + size] = [True] * size
        runs = sum(g for g, _ in itertools.groupby(gone))
        want.append((k, len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g)))
    out = suffix_dedup.remove_repeats(df, block_bytes=block_bytes, carry=("name",))
    got = [(r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in out.collect()]
    assert by_key(got) == by_key(want)
    assert {r.rest.name for r in out.collect()} == {"clash"}


def repeats_brute_force(rows):
    size, first = 50, {}
    order = lambda k: 10 ** 9 if k is None else k
    texts = [(k, (t or "").encode()) for k, t, *_ in rows]
    for k, b in texts:
        for i in range(len(b) - size + 1):
            s = b[i:i + size]
            first[s] = min(first.get(s, 10 ** 9), order(k))
    want = []
    for k, b in texts:
        gone = [False] * len(b)
        for i in range(len(b) - size + 1):
            if first[b[i:i + size]] < order(k):
                gone[i:i + size] = [True] * size
        runs = sum(g for g, _ in itertools.groupby(gone))
        want.append((k, len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g)))
    return want


@pytest.mark.parametrize("block_bytes,hot_texts", [(1 << 11, 3), (1 << 22, 3), (1 << 13, 50)])
def test_suffix_dedup_of_a_passage_in_all_documents(spark, docs, block_bytes, hot_texts):
    rnd = random.Random(4)
    some = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage, ends = some(120), [some(30) for _ in range(5)]
    rows = [(i, some(40) + rnd.choice(ends) + passage + rnd.choice(ends) + some(40), "x", "y") for i in range(150)] + docs[0]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = suffix_dedup.remove_repeats(df, block_bytes=block_bytes, hot_texts=hot_texts).collect()
    got = [(r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in out]
    assert by_key(got) == by_key(repeats_brute_force(rows))
    # the texts of a frequent gram do not meet in one shard
    d, blocks = blocks_of(df, block_bytes)
    most = []
    for limit in (hot_texts, 10 ** 9):
        _, sent = suffix_dedup._differing(d.groupBy("block"), 50, blocks, limit)
        texts = sent.where("kind = 2").groupBy("shard").agg(F.sum(F.length("key") / suffix_dedup._HEAD.itemsize).alias("n"))
        most.append(texts.agg(F.max("n")).first()[0] or 0)
    assert most[0] < most[1] and (hot_texts > 3 or 2 * most[0] < most[1])


def shingles(text):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    w = (text or "").encode().translate(low).split()
    return frozenset(tuple(w[i:i + 3]) for i in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else [])


def join_brute_force(rows):
    """(doc_id, set size, smallest linked doc_id) by comparing all pairs."""
    sets = [shingles(t) for _, t, *_ in rows]
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
            group = [group[i] if g == group[j] else g for g in group]
    out = []
    for i, (k, *_) in enumerate(rows):
        known = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        out.append((k, len(sets[i]), min(known, default=None) if sets[i] else k))
    return out


@pytest.mark.parametrize("block_bytes,slice_rows", [(1 << 11, 3), (1 << 22, 4096)])
def test_join_equals_all_pairs(spark, docs, block_bytes, slice_rows):
    rows, df = docs
    got = [tuple(r) for r in ngram_join.link_documents(df, block_bytes=block_bytes, slice_rows=slice_rows).collect()]
    assert by_key(got) == by_key(join_brute_force(rows))


def test_join_of_many_near_copies(spark):
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(130)]
    rows = []
    for i in range(160):        # variants around two sources, and chains between them
        w = list(base if i % 2 else base[40:] + base[:40])
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(len(w))] = f"v{rnd.randrange(60)}"
        rows.append((1000 - i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = [tuple(r) for r in ngram_join.link_documents(df, block_bytes=1 << 13, slice_rows=16).collect()]
    want = join_brute_force(rows)
    assert by_key(got) == by_key(want) and 1 < len({w[2] for w in want}) < 160


def test_sketch_bounds_the_difference():
    rnd = np.random.default_rng(1)
    bands = ngram_join.Bands(90)
    for n in (1, 5, 10, 40, 333, 2500):
        b = bands.band(n)
        assert bands.band(bands.top(b)) == b < bands.band(bands.top(b) + 1)
        a = np.unique(rnd.integers(0, 2 ** 63, n).astype(np.uint64))
        drop = int(rnd.integers(0, max(1, n // 20) + 1))
        c = np.unique(np.concatenate([a[drop:], rnd.integers(0, 2 ** 63, drop).astype(np.uint64)]))
        for parts in (1, 7, 60):
            distance = int(np.bitwise_count(ngram_join.sketch(a, parts) ^ ngram_join.sketch(c, parts)).sum())
            assert distance <= len(np.setxor1d(a, c))
        # sets that link always share a key
        both = len(np.intersect1d(a, c))
        if 100 * both >= 90 * (len(a) + len(c) - both) and len(np.setxor1d(a, c)):
            ka, kc = ({int(x) for _, k, _ in ngram_join.band_keys(s, bands) for x in k} for s in (a, c))
            assert ka & kc


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_key_and_unrelated_sets_meet_nowhere(percent):
    rnd = np.random.default_rng(percent)
    bands = ngram_join.Bands(percent)
    fresh = lambda n: rnd.integers(0, 2 ** 64, n, dtype=np.uint64)
    keys = lambda s: {int(x) for _, k, _ in ngram_join.band_keys(s, bands) for x in k}
    linked = 0
    for n in [*range(1, 60), 100, 400, 1500] * 4:
        a = np.unique(fresh(n))
        drop = int(rnd.integers(0, n * (100 - percent) // 100 + 2))
        c = np.unique(np.concatenate([a[drop // 2:], fresh(drop - drop // 2)]))
        both = len(np.intersect1d(a, c))
        if len(np.setxor1d(a, c)) and 100 * both >= percent * (len(a) + len(c) - both):
            linked += 1
            assert keys(a) & keys(c)
    assert linked > 30
    for count in (500, 2000):
        members: dict[int, int] = {}
        for _ in range(count):
            for k in keys(np.unique(fresh(400))):
                members[k] = members.get(k, 0) + 1
        pairs = sum(m * (m - 1) // 2 for m in members.values())
        assert pairs <= 1e-4 * count * (count - 1) / 2


def test_pieces_do_not_depend_on_the_order_of_rows(spark):
    rows = corpus(9, 40)
    rows += rows[:3] * 4
    packed = []
    for order in (lambda d: d.coalesce(1).sortWithinPartitions("doc_id", "text"),
                  lambda d: d.coalesce(1).sortWithinPartitions(F.desc("text"), F.desc("doc_id"))):
        out = packing.pack_documents(order(spark.createDataFrame(rows, SCHEMA)), tokenizer_path(), group_rows=16)
        packed.append(by_key(out.select("doc_id", "start", "length", "doc_tokens", "ids").collect()))
    assert packed[0] == packed[1] and sum(p[1] == 0 for p in packed[0]) == len(rows)


def test_decontamination(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    items = {i: [word() for _ in range(n)] for i, n in enumerate((15, 30, 60, 9, 8, 4))}
    noise = lambda n: [word() for _ in range(n)]
    worn = lambda w, places: [word() if i in places else x for i, x in enumerate(w)]
    rows = [(1, noise(50) + items[0] + noise(20)), (2, worn(items[1], {7, 19})), (3, [x.upper() + "," for x in items[2]]),
            (4, noise(5) + items[2][20:45]), (5, noise(300)), (6, noise(9) + items[3]), (7, items[4] + noise(4)),
            (8, items[5] + noise(30)), (9, items[0][:8] + noise(8)), (10, worn(items[2], set(range(0, 60, 2)))),
            (11, items[3][1:])]
    docs = [(k, " ".join(w), "s") for k, w in rows] + [(12, None, "s"), (13, "", None), (None, " ".join(items[0]), "s")]
    docs.append(docs[0])
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(i, " ".join(w), 0) for i, w in items.items()] + [(77, None, 0), (None, "x", 0)],
                                  "item_id long, text string, doc_id long")
    want = [(1, 0), (1, 0), (2, 1), (3, 2), (4, 2), (6, 3), (7, 4), (None, 0)]
    for parts in (1_000_000, 40):
        got = [(r.doc_id, r.item_id) for r in decontam.overlaps(df, bench, index_words=parts).collect()]
        assert by_key(got) == by_key(want)
    place = {r.doc_id: r for r in decontam.overlaps(df, bench).collect()}
    text = dict((k, t) for k, t, _ in docs)
    assert text[4].encode()[place[4].char_start:place[4].char_end].decode() == " ".join(items[2][20:45])
    kept = decontam.clean(df, bench)
    assert kept.schema == df.schema and {r.doc_id for r in kept.collect()} == {5, 8, 9, 10, 11, 12, 13}


@pytest.fixture(scope="module")
def packed(spark, docs):
    rows, df = docs
    more = [(9000 + i, " ".join(WORDS) * (i % 50) + "<|endoftext|> it's  odd ", "", "") for i in range(150)]
    df = df.unionByName(spark.createDataFrame(more, SCHEMA))
    return rows + more, packing.pack_documents(df, tokenizer_path(), group_rows=64).collect()


def test_pieces_hold_each_token_once(packed):
    from tokenizers import Tokenizer
    rows, out = packed
    tok = Tokenizer.from_file(tokenizer_path())
    tok.encode_special_tokens = True
    want = []
    for k, t, *_ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(k, s, len(ids[s:s + 2048]), len(ids), zlib.crc32(np.array(ids[s:s + 2048], "<u4").tobytes()))
                 for s in range(0, len(ids), 2048)]
    assert by_key([(r.doc_id, r.start, r.length, r.doc_tokens, zlib.crc32(r.ids)) for r in out]) == by_key(want)


def test_sequences_are_gapless_and_full(packed):
    _, out = packed
    seqs = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r.length for r in out) > 0.85 * 2048 * len(seqs)


def test_differencing_splits_evenly():
    rnd = np.random.default_rng(4)
    size = np.array([4, 5, 6, 7, 8])       # differencing by hand: 8-7, 6-5, 4-1, 3-1 leaves 2
    assert sorted(np.bincount(packing.difference(size, 2), size).tolist()) == [14, 16]
    for n, k in ((1, 1), (1, 3), (7, 3), (200, 9), (64, 64)):
        size = rnd.integers(1, 900, n)
        at = packing.difference(size, k)
        load = np.bincount(at, size, minlength=k)
        assert len(load) == k and load.sum() == size.sum()
        if n > 10 * k:
            assert load.max() - load.min() <= size.max() // 10
    at, k = packing.split_windows(np.array([1500] * 5), 2048)       # no two fit: the count rises
    assert k == 5 and sorted(at.tolist()) == list(range(5))


def test_empty_tables(spark, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert phrases.remove_passages(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert ngram_join.link_documents(none).count() == 0
    assert packing.pack_documents(none, tokenizer_path()).count() == 0
    some = spark.createDataFrame([(1, "a b c", "", "")], SCHEMA)
    assert decontam.clean(some, bench).count() == 1
    assert decontam.overlaps(none, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_query_digests(spark, docs):
    """The derived digest equals the digest of the operator's real output."""
    _, df = docs
    out = phrases.remove_passages(df).select("kept", F.sha2(F.col("kept").cast("binary"), 256).alias("h")).collect()
    assert all(r.h == hashlib.sha256(r.kept.encode()).hexdigest() for r in out)
