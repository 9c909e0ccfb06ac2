"""Fingerprints, spelling variants and tokenizer alignment against brute force."""
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import alignment, fingerprints, spelling
from ledgerloom.llm.queries import QUERIES, tokenizer_path
from ledgerloom.llm.textblocks import as_bytes

SCHEMA = "doc_id long, text string, rank string, own string, block string, word string"
SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA).repartition(3)


def corpus(seed, size=40):
    rnd = random.Random(seed)
    words = ["alpha", "beta", "g", "Déjà", "x1,", "don't", "日本語", "😀", "(a)", "été"]
    text = lambda n: rnd.choice([" ", " ", "  ", "\n"]).join(rnd.choice(words) + rnd.choice(["", "", "s"]) for _ in range(n))
    shared = text(60)
    rows = [(7 * i + 1, text(rnd.randrange(60)) + rnd.choice(["", " " + shared])) for i in range(size)]
    return rows + [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "one"), (1004, "a b c"), (None, shared), (None, None),
                   (1005, " ".join(text(9) for _ in range(400))), rows[0], rows[1], (rows[2][0], "other text of that id")]


# ---- fingerprints -------------------------------------------------------------------------

def py_prints(text, gram=fingerprints.GRAM, window=fingerprints.WINDOW):
    single = "぀-ヿ㐀-鿿가-힯豈-﫿"
    tokens = re.findall(f"[{single}]|[^ \t-\r{single}]+", text or "")
    v = [zlib.crc32(t.encode()) & (2 ** 31 - 1) for t in tokens]
    h = []
    for i in range(max(1, len(v) - gram + 1) if v else 0):
        x = 0
        for t in v[i:i + gram]:
            x = (x * fingerprints.BASE + t) % fingerprints.PRIME
        h.append(x)
    out = []
    for s in range(max(1, len(h) - window + 1) if h else 0):
        run = h[s:s + window]
        at = s + max(j for j, x in enumerate(run) if x == min(run))
        if (h[at], at) not in out:
            out.append((h[at], at))
    return out


def py_like(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_fingerprints_equal_brute_force(spark):
    rows = corpus(3)
    got = fingerprints.neighbour_fingerprints(frame(spark, rows)).collect()
    keys = sorted({((r[0] is None, -(r[0] or 0)), fingerprint_digest(spark, r[1]), r[1] or "") for r in rows})
    after = {k: keys[(i + 1) % len(keys)][2] for i, k in enumerate(keys)}
    want = []
    for key, t in rows:
        t = t or ""
        nxt = after[((key is None, -(key or 0)), fingerprint_digest(spark, t), t)]
        n = len(t) // 3
        edited = t[:len(t) - n] + nxt[:n]
        a, b, c = py_prints(t), py_prints(edited), py_prints(nxt)
        name = lambda p: " ".join(f"{h}@{i}" for h, i in p)
        want.append((-1 if key is None else key, len(t), edited, name(a), name(b), py_like(a, b), py_like(a, c)))
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in map(tuple, got)) == sorted(want)


_DIGESTS = {}


def fingerprint_digest(spark, text):
    if text not in _DIGESTS:
        _DIGESTS[text] = spark.range(1).select(F.xxhash64(F.lit(text or ""))).first()[0]
    return _DIGESTS[text]


def test_match_guarantee(spark):
    rnd = random.Random(8)
    least = fingerprints.GRAM + fingerprints.WINDOW - 1
    rows = []
    for k in range(30):
        shared = [f"s{k}_{j}" for j in range(least)]
        for side in (0, 1):
            pre, post = ([f"{side}{k}{p}{rnd.randrange(99)}" for _ in range(rnd.randrange(30))] for p in "pq")
            rows.append((k, side, " ".join(pre + shared + post), len(pre)))
    d = spark.createDataFrame(rows, "k long, side int, text string, at int")
    got = d.select("k", "side", "at", fingerprints.prints(F.col("text")).alias("p")).collect()
    places = {(r.k, r.side): {(p >> 31, 2 ** 31 - 1 - (p & (2 ** 31 - 1)) - r["at"]) for p in r.p} for r in got}
    assert all(places[k, 0] & places[k, 1] for k in range(30))     # the same hash at the same place of the passage


def test_fingerprints_edge_tables(spark):
    none = frame(spark, [(1, "x")]).where("false")
    assert fingerprints.neighbour_fingerprints(none).count() == 0
    one = fingerprints.neighbour_fingerprints(frame(spark, [(5, "abcdef")])).first()
    assert (one.n_chars, one.edited, one.near_next) == (6, "abcdab", 1.0)
    odd = {r.doc_id: r for r in fingerprints.neighbour_fingerprints(frame(spark, [(1, None), (2, ""), (3, "a b")])).collect()}
    assert odd[1].fingerprint == odd[2].fingerprint == "" and odd[2].near_next == 1.0 and odd[3].near_next == 0.0


def test_fingerprint_query_has_no_python(spark):
    plan = QUERIES["op11_fingerprints"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- spelling variants --------------------------------------------------------------------

def py_variants(count, factor=2):
    masked, near = {}, {w: set() for w in count}
    for w in count:
        for i in range(len(w)):
            masked.setdefault((w[:i], w[i + 1:]), []).append(w)     # equal but for one letter
            less = w[:i] + w[i + 1:]
            if less in near:
                near[w].add(less)
                near[less].add(w)
    for same in masked.values():
        for w in same:
            near[w].update(v for v in same if v != w)
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= factor * count[w] else None
    out = []
    for w in count:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, count[w], len(near[w]), count[form[w]] if form[w] is not None else None))
    return sorted(out)


def random_words(seed, size):
    rnd = random.Random(seed)
    words = set()
    while len(words) < size:
        w = "".join(rnd.choice("abcdeéß") for _ in range(rnd.randrange(4, 9)))
        words.add(w)
        for _ in range(3):
            i = rnd.randrange(len(w))
            words.add(rnd.choice([w[:i] + w[i + 1:], w[:i] + rnd.choice("abxé") + w[i:], w[:i] + "z" + w[i + 1:]]))
    words |= {"", "a", "b", "ab", "ba", "Ωmega", "Ωmegb", "日本語", "日本"}
    return {w: 2 ** rnd.randrange(7) + rnd.randrange(3) for w in sorted(words)}


@pytest.mark.parametrize("cell_words", [30, 2048])
def test_variants_equal_all_pairs(spark, cell_words):
    count = random_words(cell_words, 700)
    rows = [(w, n, "clash") for w, n in count.items()] + [(None, 9, "clash"), ("ab", 1, "clash")]
    words = spark.createDataFrame(rows, "word string, n long, best string").repartition(3)
    got = spelling.variants(words.drop("best"), cell_words=cell_words).collect()
    assert sorted(map(tuple, got)) == py_variants(count)


def test_kd_tree_reaches_all_in_range():
    rnd = np.random.default_rng(1)
    v = rnd.integers(0, 4, (400, 6)).astype(np.int16)
    q = rnd.integers(0, 4, (60, 6)).astype(np.int16)
    for radius in (0, 1, 2):
        tree = spelling.KdTree(v, 8)
        assert sorted(np.concatenate(tree.leaves).tolist()) == list(range(400))
        found = {(int(i), int(p)) for leaf, qs in tree.reach(q, radius) for i in qs for p in tree.leaves[leaf]
                 if np.abs(v[p] - q[i]).sum() <= radius}
        want = {(i, p) for i in range(60) for p in range(400) if np.abs(v[p] - q[i]).sum() <= radius}
        assert found == want
    assert len(spelling.KdTree(np.ones((100, 3), np.int16), 8).leaves) == 1     # equal vectors cannot be cut


def test_marked_words_and_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    count = {}
    for key, text in [*map(tuple, rows)]:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{key}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] = count.get(run, 0) + 1
    count = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    got = QUERIES["op12_spelling"](spark, SF)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == py_variants(count)


def test_spelling_edge_tables(spark):
    docs = frame(spark, [(1, None), (None, "Hello hello HELLO Àxxxx×÷Àxxxx ÀXXXX"), (2, ""), (3, "hi")])
    words = {r.word: r.n for r in spelling.marked_words(docs, modulus=10 ** 9).collect()}
    assert words == {"hello": 3}
    assert spelling.variants(spelling.marked_words(docs.where("false"))).count() == 0
    one = spelling.variants(spark.createDataFrame([("hello", 3)], "word string, n long")).collect()
    assert [tuple(r) for r in one] == [("hello", None, "hello", 3, 0, None)]


# ---- tokenizer alignment ------------------------------------------------------------------

PATHS = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")


def py_align(texts):
    """Per text (n_a, n_b, n_groups, links, groups, links by group), from whole lines."""
    tok = alignment.tokenizers(*PATHS)
    out = []
    for t in texts:
        if not t:
            out.append((0, 0, 0, [], "", 0))
            continue
        line = (" " + t).encode()
        a, b = (x[0] for x in tok.encode([" " + t]))
        if b"".join(tok.bytes_a[i] for i in a) != line or b"".join(tok.bytes_b[i] for i in b) != line:
            out.append((0, 0, 0, [], "", 0))
            continue
        ea, eb = np.cumsum(tok.size_a[a]), np.cumsum(tok.size_b[b])
        owner = np.repeat(np.arange(len(b)), tok.size_b[b])
        links = []
        for i, end in enumerate(ea):
            links += [(a[i], b[j]) for j in sorted(set(owner[end - tok.size_a[a[i]]:end].tolist()))]
        ends = sorted(set(ea.tolist()) & set(eb.tolist()))
        ga, gb = np.searchsorted(ends, ea), np.searchsorted(ends, eb)
        cells = [([], []) for _ in ends]
        for side, (ids, group) in enumerate(((a, ga), (b, gb))):
            for x, g in zip(ids, group):
                cells[g][side].append(x)
        groups = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in cells)
        out.append((len(a), len(b), len(ends), links, groups, sum(len(x) * len(y) for x, y in cells)))
    return out


def py_digest(rows):
    got = py_align([t for _, t in rows])
    docs = {}
    for _, _, _, links, _, _ in got:
        for p in set(links):
            docs[p] = docs.get(p, 0) + 1
    most = {}
    for (a, _), n in docs.items():
        most[a] = max(n, most.get(a, 0))
    return sorted(((-1 if k is None else k, na, nb, ng, len(ln), gl, sum(docs[p] == most[p[0]] for p in ln),
                    sum(docs[p] for p in ln), hashlib.sha256(g.encode()).hexdigest() if na else "")
                   for (k, _), (na, nb, ng, ln, g, gl) in zip(rows, got)))


def test_alignment_equals_brute_force(spark):
    rows = [r for r in corpus(11) if r[0] != 1005]
    rows += [(2000, "<s> <|endoftext|> </s> <0x41> <unk>"), (2001, "has ▁ in it, and more words"), (2002, "a▁"),
             (2003, "tab\tand   blank"), (2004, " lead"), (2005, "trail "), (2006, "x" * 3000), (2007, "é ﬁ Ⅳ ½"),
             (2008, "it's  we'll 'tis 12 345 a-b\r\nc"), (2009, "\u0000 \x1c �"), (2010, "naïve café — “q”")]
    got = alignment.align_documents(frame(spark, rows), *PATHS, block_bytes=4000).collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in map(tuple, got)) == py_digest(rows)
    assert {r.doc_id: r.n_a for r in got}[2001] == 0        # the blank sign is given back as a blank


def test_alignment_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op13_alignment"](spark, SF)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect())) == [(*r[:5], *r[6:]) for r in py_digest(rows)]
    assert alignment.align_documents(frame(spark, [(1, "x")]).where("false"), *PATHS).count() == 0


def test_row_products():
    rnd = np.random.default_rng(2)
    a, b = (rnd.random((7, 9)) < .3).astype(int), (rnd.random((9, 5)) < .3).astype(int)
    csr = lambda m: (np.concatenate([[0], np.cumsum(m.sum(1))]), np.nonzero(m)[1])
    ptr, col, value = alignment.row_products(*csr(a), *csr(b), 5)
    dense = np.zeros((7, 5), int)
    dense[np.repeat(np.arange(7), np.diff(ptr)), col] = value
    assert (dense == a @ b).all()
    tp, tc = alignment.transposed(*csr(b), 5)
    assert [x.tolist() for x in csr(b.T)] == [tp.tolist(), tc.tolist()]
    assert as_bytes([None]) == [b""]
