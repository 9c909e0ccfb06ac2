"""Archives, chat rendering, URL rules, nearest neighbours, toxicity and the pipeline."""
import hashlib
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import ann_forest, chat, toxicity, url_rules, warc
from ledgerloom.llm.queries import ORACLES, QUERIES, URL_RULES
from tests.conftest import SF001


def rows_of(df):
    return sorted((tuple(-1 if v is None else v for v in r) for r in df.collect()), key=repr)


# --- WARC -----------------------------------------------------------------------------------

PAGES = [(1, "http://a/", "x" * 200, 0), (2, None, "x" * 200, 0), (3, "http://b/\r\nInjected: 1", "é" * 50, 0),
         (4, "http://c/", None, 0), (5, "http://d/", "", 0), (6, "http://e/", "y" * 99, 0), (7, "http://f/", "y" * 99, 0),
         (None, "http://g/", "x" * 200, 0), (8, "http://h/", "z" * 300_000, 0), (9, "http://i/", "é" * 50, 0),
         (10, "http://j/", "\r\n\r\nWARC/1.1\r\n\r\n" * 9, 0), (1, "http://a/", "x" * 200, 0)]


@pytest.fixture(scope="module", params=["true", "false"])
def archive(spark, request, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc") / "a")
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string, payload long").repartition(3)
    warc.write_warc(warc.page_records(df), path, gzip=request.param, file_bytes="1000")
    return path


def test_round_trip(spark, archive):
    out = {(r.record_id, r.record_type): r for r in warc.read_warc(spark, archive).collect()}
    for k, url, html, _ in PAGES:
        data = (html or "").encode()
        same = [p for p, _, h, _ in PAGES if (h or "") == (html or "") and p is not None]
        revisit = len(data) >= 100 and k != min(same)
        r = out["urn:x-page:none" if k is None else f"urn:x-page:{k}", "revisit" if revisit else "response"]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert r.payload == (None if revisit else data)
        assert r.refers_to == (f"urn:x-page:{min(same)}" if revisit else None)
        assert r.target_uri == (" ".join(url.splitlines()) if url else None)
    assert warc.read_warc(spark, archive).count() == len(PAGES)


def test_predicates_reach_the_reader(spark, archive):
    df = warc.read_warc(spark, archive, payload="skip").where("record_type = 'revisit'")
    assert {r.record_id for r in df.collect()} == {"urn:x-page:2", "urn:x-page:9", "urn:x-page:none"}
    one = warc.read_warc(spark, archive).where(F.col("target_uri").startswith("http://h") & (F.col("payload_bytes") > 5))
    assert [len(r.payload) for r in one.collect()] == [300_000]
    assert warc.read_warc(spark, archive).where(F.col("target_uri").isNull()).count() == 1
    reader = warc.WarcReader({"path": archive})
    kept = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload_bytes",), 5)]))
    assert [f.attribute for f in kept] == [("payload_bytes",)] and reader.tests == [("record_type", "in", ("revisit",))]


def test_skipped_payloads_are_not_read():
    big = warc.record_bytes({"record_type": "response", "record_id": "a", "payload": bytes(np.random.default_rng(0).bytes(3_000_000))})
    small = warc.record_bytes({"record_type": "response", "record_id": "b", "payload": b"hi"})
    for data in (big + small, warc.gzip_member(big) + warc.gzip_member(small)):
        class Counting(io.BytesIO):
            seen = 0

            def read(self, n=-1):
                got = super().read(n)
                self.seen += len(got)
                return got
        f = Counting(data)
        assert [r["payload"] for r in warc.records(f, len(data), lambda r: r["record_id"] == "b", "keep")] == [b"hi"]
        assert f.seen < 300_000


def test_foreign_gzip_members_and_folded_headers():
    import gzip
    raw = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <u:1>\r\nWARC-Target-URI: a\r\n b\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    data = gzip.compress(raw) + gzip.compress(raw.replace(b"u:1", b"u:2"))
    got = list(warc.records(io.BytesIO(data), len(data), lambda r: r["record_id"] == "u:2", "keep"))
    assert [(r["record_id"], r["target_uri"], r["payload"]) for r in got] == [("u:2", "a b", b"hello")]


def test_uncommitted_files_are_not_read(spark, archive, tmp_path):
    with open(f"{archive}/lost-attempt.warc", "wb") as f:
        f.write(warc.record_bytes({"record_type": "response", "record_id": "lost", "payload": b""}))
    assert warc.read_warc(spark, archive).where("record_id = 'lost'").count() == 0
    assert warc.read_warc(spark, str(tmp_path / "nothing")).count() == 0


# --- chat -----------------------------------------------------------------------------------

def test_perspectives_match_direct_rendering(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "ann", "é" * 5), (1, 3, "eve", ""),
             (2, 0, "system", "nobody"), (None, 0, None, "lost"), (None, None, "ann", "first"), (3, 5, "ann", "x"), (3, 5, "ann", "x")]
    df = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, speaker string")
    got = chat.perspectives(df)
    want = []
    for conv in {t[0] for t in turns}:
        own = sorted(((-1 if t[1] is None else t[1]), t[2] or "unknown", t[3] or "", t[1]) for t in turns if t[0] == conv)
        for who in {r for _, r, _, _ in own} - {"system"}:
            at = 0
            for _, role, text, turn in own:
                head = "<|assistant|>\n" if role == who else "<|system|>\n" if role == "system" else f"<|user name={role}|>\n"
                seg = head + text + "<|end|>\n"
                end = at + len(seg)
                want.append((conv, who, turn, role, seg, at, end, at + len(head) if role == who else end, end))
                at = end
    assert rows_of(got) == sorted((tuple(-1 if v is None else v for v in r) for r in want), key=repr)
    whole = {(r.conv_id, r.speaker): r for r in chat.dialogues(got).collect()}[1, "ann"]
    assert [whole.text[m[0]:m[1]] for m in whole.learned] == ["hi<|end|>\n", "é" * 5 + "<|end|>\n"]
    assert chat.perspectives(df.limit(0)).count() == 0


# --- URL rules ------------------------------------------------------------------------------

def test_fixed_rules(spark):
    urls = {"http://a.NET/x": ("a.net", "/x", "net/", "block"), "https://www.example.net/en/1?q": ("www.example.net", "/en/1", "example.net/en/", "allow"),
            "http://example.com/de/#f": ("example.com", "/de/", "example.com/de/", "block"), "http://notexample.com/de/": ("notexample.com", "/de/", None, None),
            "http://org/fr/x": ("org", "/fr/x", "org/fr/", "allow"), "http://net": ("net", "", None, None), "http://net?x=/": ("net", "", None, None),
            "no scheme": ("", "", None, None), None: ("", "", None, None), "a://b://c/d": ("b:", "//c/d", None, None), "": ("", "", None, None),
            "http://ÄB.org/fr/é": ("Äb.org", "/fr/é", "org/fr/", "allow"), "http://u:p@x.net:80/": ("u:p@x.net:80", "/", None, None)}
    df = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)] * 2, "page_id long, url string, verdict string")
    out = url_rules.judge_urls(df, URL_RULES).collect()
    assert len(out) == 2 * len(urls)
    for r in out:
        host, path, rule, verdict = urls[r.url]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ([verdict] if verdict else ["allow", "block"])
    assert url_rules.judge_urls(df.limit(0), URL_RULES).count() == 0


def test_mined_rules_equal_brute_force(spark):
    rnd = random.Random(2)
    rows = []
    for _ in range(400):
        t = {x for x in "abcdef" if rnd.random() < 0.4}
        rows.append((sorted(t), "block" if {"a", "b"} <= t or "e" in t and rnd.random() < 0.9 else "allow"))
    got = {(tuple(r.tokens), r.verdict): (r.confidence, r.support)
           for r in url_rules.mine_rules(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.05, 0.8).collect()}
    want, found = {}, {}
    for mask in range(1, 64):
        s = tuple(x for i, x in enumerate("abcdef") if mask >> i & 1)
        have = [v for t, v in rows if set(s) <= set(t)]
        for v in ("allow", "block"):
            n = have.count(v)
            if n >= 0.05 * 400 and n / len(have) >= 0.8:
                found[s, v] = (n / len(have), n / 400)
    for (s, v), (c, sup) in found.items():
        if not any(found.get((s[:i] + s[i + 1:], v), (0,))[0] >= c for i in range(len(s)) if len(s) > 1):
            want[s, v] = (c, sup)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_index_matches_every_rule_whose_tokens_occur(spark):
    rules = spark.createDataFrame([(["a", "b"], "block", 0.9, 0.1), (["c"], "allow", 0.95, 0.1), (["a"], "allow", 0.8, 0.3)],
                                  "tokens array<string>, verdict string, confidence double, support double")
    urls = spark.createDataFrame([("1", ["a", "b"]), ("2", ["a"]), ("3", ["a", "b", "c"]), ("4", ["z"]), ("5", [])],
                                 "url string, tokens array<string>")
    assert rows_of(url_rules.match_rules(urls, rules)) == [("1", "block"), ("2", "allow"), ("3", "allow")]


# --- nearest neighbours ---------------------------------------------------------------------

def exact_nearest(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    return {q: sorted(((-float(x @ v), i) for i, v in good if i != q))[:k] for q, x in good if q % 5 == 0}


@pytest.mark.parametrize("norms", [False, True])
def test_nearest_recall_and_order(spark, norms):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((900, 16))
    x = x if norms else x / np.linalg.norm(x, axis=1)[:, None]
    x = x.astype(np.float32).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(2000 + i, x[3].tolist()) for i in range(300)]          # a very common vector
    rows += [(3000, None), (3005, []), (3010, [0.0] * 16), (3015, [float("nan")] + [1.0] * 15), (3020, [None] + [1.0] * 15),
             (3025, [float("inf")] + [0.0] * 15), (None, x[1].tolist()), rows[0], rows[7]]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int").repartition(4)
    out = ann_forest.nearest(df, F.col("id") % 5 == 0, k=10, trees=24, candidates=250, part_rows=3000)
    got = {}
    for r in out.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = exact_nearest(rows, 10)
    vec = {i: np.array(v) for i, v in rows if i is not None and v}
    assert got.keys() == want.keys()
    hit = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        assert all(s == pytest.approx(float(vec[q] @ vec[i]), abs=1e-12) and i != q for _, i, s in found)
        hit += len({i for _, i, _ in found} & {i for _, i in want[q]})
    assert hit >= 0.9 * 10 * len(want)


@pytest.mark.parametrize("norms", [False, True])
def test_nearest_in_a_run_longer_than_a_partition(spark, norms):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.standard_normal(16) + 0.01 * rng.standard_normal((6000, 16)), rng.standard_normal((300, 16))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    x *= np.linspace(0.99, 1, len(x))[rng.permutation(len(x))][:, None] if norms else 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    out = ann_forest.nearest(df, F.col("id") % 20 == 0, k=10, trees=24, candidates=250, part_rows=1000)
    got = {}
    for r in out.collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    asked = range(0, 6000, 20)
    score = x[::20][:len(asked)] @ x.T
    score[np.arange(len(asked)), list(asked)] = -2
    want = np.argsort(-score, 1)[:, :10]
    hits = sum(len(got.get(q, set()) & set(w.tolist())) for q, w in zip(asked, want))
    assert hits >= 0.9 * 10 * len(asked), hits / 10 / len(asked)


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert rows_of(ann_forest.nearest(df, F.col("id") == 0)) == [(0, 1, 1, 0.5)]
    assert ann_forest.nearest(df.limit(0), F.col("id") == 0).count() == 0
    assert ann_forest.nearest(df.where("vec_id = 2"), F.lit(True)).count() == 0


# --- toxicity -------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def judged(spark):
    rnd = random.Random(1)
    bad, stem = ["grobian", "schuft", "lump"], ["zurk", "vokk"]
    rows, labels = [], []
    for i in range(700):
        words = ["".join(rnd.choice("aeioulmnrst") for _ in range(rnd.randrange(2, 8))) for _ in range(rnd.randrange(5, 60))]
        toxic = rnd.random() < 0.25
        if toxic:
            for _ in range(rnd.randrange(2, 5)):
                words.insert(rnd.randrange(len(words)), rnd.choice(bad) if i % 2 else rnd.choice(stem) + rnd.choice("abcdefgh") * 3)
        rows.append((i, " ".join(words), "toxic" if toxic else "x", 1 - toxic))
        labels.append((i, int(toxic if rnd.random() > 0.02 else not toxic), 1))
    rows += [(9000, None, None, None), (9001, "", "x", 0), (None, "lump lump schuft", "x", 0), (9002, "a" * 100_000 + " schuft lump", "", 0), rows[0]]
    labels += [(None, 1, 1), (9001, None, 1), (5, 0, 1), (5, 0, 0), (123456, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, predicted int").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    return rows, docs, lab, toxicity.judge(docs, lab).collect()


def test_held_out_accuracy(judged):
    rows, _, _, out = judged
    truth = {k: s == "toxic" for k, _, s, _ in rows if k is not None and k < 9000}
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    held = [r for r in out if r.doc_id in truth and r.held_out]
    import zlib
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    caught = [r.predicted for r in held if truth[r.doc_id]]
    false = [r.predicted for r in held if not truth[r.doc_id]]
    assert len(held) > 150 and np.mean(caught) >= 0.95 and np.mean(false) <= 0.02
    by = {r.doc_id: r for r in out}
    assert by[9000].score == by[9001].score and by[9002].predicted == 1 and by[None].predicted == 1


def test_held_out_labels_are_not_read(spark, judged):
    _, docs, lab, out = judged
    flipped = lab.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.judge(docs, flipped).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.score)
    assert [r.score for r in sorted(again, key=key)] == pytest.approx([r.score for r in sorted(out, key=key)])


def test_without_labels_or_rows(spark, judged):
    _, docs, lab, _ = judged
    odd = spark.createDataFrame([(1, "you are a stupid idiot"), (2, "good day")], "doc_id long, text string")
    assert {r.doc_id: r.predicted for r in toxicity.judge(odd, lab.limit(0)).collect()} == {1: 1, 2: 0}
    assert toxicity.judge(docs.limit(0), lab).count() == 0
    kept = toxicity.keep_clean(docs, lab)
    assert kept.schema == docs.schema and 9001 in {r.doc_id for r in kept.collect()}


def test_label_model_weighs_correlated_voters():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.2
    votes = np.stack([np.where(y, rng.random(4000) < 0.7, rng.random(4000) < 0.05) for _ in range(5)], 1).astype(float)
    noisy = (rng.random(4000) < 0.3).astype(float)
    votes = np.hstack([votes, np.repeat(noisy[:, None], 6, 1)])       # six copies of a voter that knows nothing
    post = toxicity.label_model(votes, None)
    assert ((post > 0.5) == y).mean() > 0.95
    wrong = np.where(rng.random(4000) < 0.1, ~y, y)
    post = toxicity.label_model(votes, wrong)
    assert ((post > 0.5) == y).mean() > (wrong == y).mean()


# --- all queries ----------------------------------------------------------------------------

def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLES) <= set(QUERIES)


def test_suffix_stage_drops_cut_characters(spark):
    import corpus_pipeline as cp
    tail = "\u00e9" + "q" * 60                    # the shared string begins inside the letter
    rows = [(1, "x\u00c3".encode("utf-8").decode() + tail, "en", "s", 63), (2, "abc \u0169" + "q" * 60, "de", "t", 65)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in cp.suffix_stage(spark, docs, SF001).collect()}
    assert out[1].text == rows[0][1] and (out[2].text, out[2].n_chars, out[2].lang) == ("abc ", 4, "de")


def test_join_stage_equals_all_pairs(spark):
    import corpus_pipeline as cp
    rnd = random.Random(11)
    rows, level = [], []
    for i in range(6):
        base = [f"w{rnd.randrange(10 ** 6)}" for _ in range(300)]
        rows.append((10 * i, " ".join(base)))
        for k, changed in enumerate((4, 6, 6, 8), 1):     # 6 words: 0.82 by five words, 0.89 by three
            places = {(2 * j + 1) * 300 // (2 * changed) + k for j in range(changed)}
            w = [f"v{i}{k}{j}" if j in places else x for j, x in enumerate(base)]
            rows.append((10 * i + k, " ".join(w)))
    sets = {k: {tuple(w[j:j + 5]) for w in [t.split()] for j in range(len(w) - 4)} for k, t in rows}
    root = {k: k for k in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                level.append(both / (len(sets[a]) + len(sets[b]) - both))
                root = {k: min(root[a], root[b]) if r in (root[a], root[b]) else r for k, r in root.items()}
    assert sum(0.8 <= x < 0.9 for x in level) >= 12
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = {r.doc_id for r in cp.join_stage(spark, docs, SF001).collect()}
    assert kept == set(root.values()) and 6 <= len(kept) < len(rows)


def test_pipeline(spark):
    import corpus_pipeline as cp
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    own = docs.limit(3).collect()
    extra = [(900_001, own[0].text, "en", "s", 1), (900_002, None, None, None, None), (None, "some text here", "en", "s", 3)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    ck = spark.sparkContext.getCheckpointDir()
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SF001)
        before = docs
        out.write.parquet(f"{ck}/pipe-{name}")
        docs = spark.read.parquet(f"{ck}/pipe-{name}")
        if k < 4:
            assert sorted(docs.columns) == sorted(before.columns)
            assert docs.count() <= before.count()
        if name == "ngram_join":
            ids = [r.doc_id for r in docs.select("doc_id").collect()]
            assert 900_001 not in ids and own[0].doc_id in ids and 900_002 in ids and None in ids and len(ids) == len(set(ids))
    assert {r.sequence_id for r in docs.collect()} and docs.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048


def test_suffix_stage_keeps_genuine_replacement_characters(spark):
    import corpus_pipeline as cp
    shared = "passage " + "é日😀" * 30
    rows = [(1, f"start � {shared} end", "en", "s", 0), (2, f"a genuine � mark", "en", "s", 0),
            (3, f"other � {shared}� tail", "en", "s", 0), (4, f"日{shared[:60]}xé", "en", "s", 0), (5, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in cp.suffix_stage(spark, docs, "").collect()}
    assert got[1].text == rows[0][1] and got[2].text == rows[1][1] and got[5].text == ""
    texts = [(t or "").encode() for _, t, *_ in rows]
    seen: set[bytes] = set()
    for (key, *_), raw in zip(rows, texts):
        gone = set()
        for i in range(len(raw) - 49):
            if raw[i:i + 50] in seen:
                gone |= set(range(i, i + 50))
        seen |= {raw[i:i + 50] for i in range(len(raw) - 49)}
        at, want = 0, ""
        for c in raw.decode():                  # a character stays if all its bytes do
            size = len(c.encode())
            want += c if not gone & set(range(at, at + size)) else ""
            at += size
        assert got[key].text == want and got[key].n_chars == len(want)
    assert got[3].text == "other� tail"
