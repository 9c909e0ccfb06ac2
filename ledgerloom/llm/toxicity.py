"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model over
their votes, and a linear classifier trained on its posterior labels that scores every text.

1. A bounded sample of labelled rows (``max_fit_rows``, in hash order, held-out rows excluded)
   is read.  Lexicon entries - words and word beginnings - are mined from it: those that occur
   far more often in toxic rows.  They are dealt to voters by kind and hash.  A built-in list
   and writing patterns give further voters.
2. Label model (EM): a latent class, each voter's rate of firing per class, the annotation as
   one more noisy voter.  Correlations between voters that the class does not explain are
   estimated from the residuals of the posterior, and correlated voters share their weight.
3. A logistic regression on the entries, patterns and counts of a text is fitted to the
   posterior labels, and scores all rows in Arrow batches (whole texts).

Only counts and at most ``max_fit_rows`` sparse rows reach the driver; the model is at most
``max_entries`` weights.  Labels, language, source and id are never inputs of a score.

Defined cases: null text is the empty text, and gets the score of a text without any hit; a
null doc_id counts as held out; of several labels for one doc_id the larger holds; without
labels of both classes the built-in voters alone decide; an empty table gives no rows; extra
columns are ignored; repeated rows get equal scores.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textblocks import filled_id, with_null_ids

THRESHOLD = 0.7
#: Plain insults of the built-in lexicon voter.
INSULTS = ("clown", "disgusting", "idiot", "idiots", "loser", "losers", "moron", "morons", "pathetic", "scum",
           "stupid", "trash", "worthless")
BEGINNINGS = (3, 4, 5, 6)
_WORD = re.compile(r"[^\W\d_]+")
_AT_YOU = re.compile(r"\b(?:you|u|ur|your)\b[^.!?\n]{0,20}\b(?:" + "|".join(INSULTS) + r")\b", re.I)
_UPPER = re.compile("[A-Z]+")
PATTERNS = ("insult", "at_you", "shouting", "marks")


def entries_of(text: str) -> set[str]:
    """Words and word beginnings (``^`` and their letters) of a text."""
    words = set(_WORD.findall(text.lower()))
    out = set(words)
    for n in BEGINNINGS:
        out.update({"^" + w[:n] for w in words if len(w) > n})
    return out


def patterns_of(text: str, words: set[str]) -> list[int]:
    insult = not words.isdisjoint(INSULTS)
    upper = len(text) - len(_UPPER.sub("", text))
    return [int(insult), int(insult and bool(_AT_YOU.search(text))), int(2 * upper > len(text)),
            int(50 * text.count("!") > len(text))]


class Matcher:
    """Hits of a fixed list of entries in a text."""

    def __init__(self, entries: list[str]):
        self.words = {e: i for i, e in enumerate(entries) if e[0] != "^"}
        self.starts = [(n, {e[1:]: i for i, e in enumerate(entries) if e[0] == "^" and len(e) == n + 1})
                       for n in BEGINNINGS]
        self.starts = [(n, d) for n, d in self.starts if d]

    def hits(self, text: str) -> tuple[list[int], list[int], int]:
        """(entries that occur, patterns, number of distinct words)."""
        words = set(_WORD.findall(text.lower()))
        found = [self.words[w] for w in words & self.words.keys()]
        for n, d in self.starts:
            begin = {w[:n] for w in words if len(w) > n}
            found += [d[b] for b in begin & d.keys()]
        return sorted(found), patterns_of(text, words), len(words)


# --- what is learned ------------------------------------------------------------------------

def _correlation(rest: np.ndarray) -> np.ndarray:
    scaled = rest / (np.sqrt((rest ** 2).mean(0)) + 1e-9)
    return scaled.T @ scaled / max(1, len(rest))


def label_model(votes: np.ndarray, given: np.ndarray | None, rounds: int = 30) -> np.ndarray:
    """Posterior of the toxic class per row.

    votes: 0/1 (rows, voters); given: annotated class per row, or None.  EM for the class prior
    and each voter's firing rate per class; a voter's evidence is divided by one plus its summed
    residual correlation with the others, so near-copies of a voter do not count twice."""
    same = np.abs(np.nan_to_num(_correlation(votes - votes.mean(0)))) > 0.8     # copies of one voter
    share = 1 / np.maximum(same.sum(1), 1)
    told = votes @ share
    post = given.astype(float) if given is not None else (told > told.mean()).astype(float)
    post = np.clip(post, 0.05, 0.95)
    for step in range(rounds):
        prior = np.clip(post.mean(), 1e-3, 1 - 1e-3)
        on = np.clip((post @ votes + 0.5) / (post.sum() + 1), 1e-4, 1 - 1e-4)
        off = np.clip(((1 - post) @ votes + 0.5) / ((1 - post).sum() + 1), 1e-4, 1 - 1e-4)
        if step in (5, 15):
            corr = np.abs(_correlation(votes - (np.outer(post, on) + np.outer(1 - post, off))))
            np.fill_diagonal(corr, 0)
            share = 1 / (1 + np.where(corr > 0.1, corr, 0).sum(1))
        logit = np.log(prior / (1 - prior)) + votes @ (share * np.log(on / off)) \
            + (1 - votes) @ (share * np.log((1 - on) / (1 - off)))
        if given is not None:       # the annotation as a voter: how often it agrees with the class
            hit = np.clip((post * given).sum() / post.sum(), 0.55, 0.995)
            false = np.clip(((1 - post) * given).sum() / (1 - post).sum(), 0.005, 0.45)
            logit += np.where(given == 1, np.log(hit / false), np.log((1 - hit) / (1 - false)))
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return post


def fit_linear(rows: list[np.ndarray], extra: np.ndarray, target: np.ndarray, size: int,
               rounds: int = 400, penalty: float = 2e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression on soft targets by gradient steps with momentum (sparse 0/1 rows plus
    dense extras), both classes weighted alike."""
    n = len(rows)
    at = np.repeat(np.arange(n), [len(r) for r in rows])
    col = np.concatenate(rows) if n else np.zeros(0, np.int64)
    col = col.astype(np.int64)
    weight = np.where(target > 0.5, 0.5 / max(target.sum(), 1e-9), 0.5 / max((1 - target).sum(), 1e-9))
    w, e, b = np.zeros(size), np.zeros(extra.shape[1]), 0.0
    mw, me, mb = np.zeros(size), np.zeros(extra.shape[1]), 0.0
    vw, ve, vb = np.zeros(size), np.zeros(extra.shape[1]), 0.0
    for t in range(1, rounds + 1):
        z = b + extra @ e + np.bincount(at, w[col], minlength=n)
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target)
        gw = np.bincount(col, g[at], minlength=size) + penalty * w
        ge, gb = extra.T @ g + penalty * e, g.sum()
        out = []
        for p, m, s, d in ((w, mw, vw, gw), (e, me, ve, ge), (b, mb, vb, gb)):
            m = 0.9 * m + 0.1 * d
            s = 0.999 * s + 0.001 * d * d
            out.append((p - 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.999 ** t)) + 1e-8), m, s))
        (w, mw, vw), (e, me, ve), (b, mb, vb) = out
    return w, e, float(b)


def extras(found: int, patterns: list[int]) -> list[float]:
    return [float(found > 0), float(np.log1p(found)), *map(float, patterns)]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, max_fit_rows: int = 12_000, max_entries: int = 2_000,
        voters: int = 16, min_rows: int = 4) -> dict:
    """The model: entries, weights, weights of the extras, bias."""
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit_rows)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    # a text counts once per class, so that copies do not make their words look frequent
    rows = rows.groupBy(F.sha2("text", 256).alias("h"), "toxic").agg(F.first("text").alias("text")).drop("h")

    def count(batches):
        on, off = Counter(), Counter()
        n = [0, 0]
        for pdf in batches:
            for text, y in zip(pdf["text"], pdf["toxic"]):
                n[int(y == 1)] += 1
                (on if y == 1 else off).update(entries_of(text))
        keys = [k for k in on]
        keys += [k for k in off if k not in on]
        for i in range(0, len(keys), 100_000):
            part = keys[i:i + 100_000]
            yield pd.DataFrame({"entry": part, "on": [on[k] for k in part], "off": [off[k] for k in part]})
        yield pd.DataFrame({"entry": [""], "on": [n[1]], "off": [n[0]]})

    counts = rows.mapInPandas(count, "entry string, on long, off long").groupBy("entry").agg(
        F.sum("on").alias("on"), F.sum("off").alias("off"))
    counts = counts.where(f"entry = '' or (on >= {min_rows} and on > off)")
    best = counts.orderBy(F.expr("entry = ''").desc(), (F.col("on") - 4 * F.col("off")).desc(), "entry").limit(max_entries + 1)
    best = best.toPandas()
    size = best[best["entry"] == ""]
    best = best[best["entry"] != ""]
    if not len(size) or size["on"].iloc[0] == 0 or size["off"].iloc[0] == 0:
        return {"entries": [], "weights": [], "extras": [0.0, 0.0, 4.0, 1.0, 0.0, 0.0], "bias": -3.0}
    base = size["off"].iloc[0] / size["on"].iloc[0]
    best = best[(best["on"] * base) >= 5 * (best["off"] + 0.5)]
    entries = best["entry"].tolist()

    def sparse(batches):
        m = Matcher(entries)
        for pdf in batches:
            got = [m.hits(t) for t in pdf["text"]]
            yield pd.DataFrame({"found": [g[0] for g in got], "patterns": [g[1] for g in got],
                                "toxic": pdf["toxic"].astype("int64").to_numpy()})

    got = rows.mapInPandas(sparse, "found array<int>, patterns array<int>, toxic long").toPandas()
    found = [np.array(f, np.int64) for f in got["found"]]
    kind = np.array([(hash_of(e) % (voters // 2)) + (voters // 2) * (e[0] == "^") for e in entries] or [0])
    votes = np.zeros((len(got), voters + len(PATTERNS)))
    for i, f in enumerate(found):
        if len(f):
            votes[i, kind[f]] = 1
        votes[i, voters:] = got["patterns"].iloc[i]
    given = got["toxic"].to_numpy()
    post = label_model(votes, given)
    dense = np.array([extras(len(f), list(p)) for f, p in zip(found, got["patterns"])])
    w, e, b = fit_linear(found, dense, post, max(1, len(entries)))
    return {"entries": entries, "weights": w.tolist(), "extras": e.tolist(), "bias": b}


def hash_of(entry: str) -> int:
    return zlib.crc32(entry.encode())


def scorer(model: dict):
    """A function from texts to scores."""
    m = Matcher(model["entries"])
    w, e, b = np.array(model["weights"] or [0.0]), np.array(model["extras"]), model["bias"]

    def run(texts) -> np.ndarray:
        z = np.empty(len(texts))
        for i, t in enumerate(texts):
            found, patterns, _ = m.hits(t or "")
            z[i] = b + w[found].sum() + e @ np.array(extras(len(found), patterns))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs(doc_id, text) -> doc_id, score; whole texts in Arrow batches."""

    def run(batches):
        of = scorer(model)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": of(pdf["text"])})

    return with_null_ids(docs.select(filled_id(), F.coalesce("text", F.lit("")).alias("text"))
                         .mapInPandas(run, "doc_id long, score double"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **params) -> DataFrame:
    """The rows of docs, with all their columns, that score below the threshold."""
    model = fit(docs, labels, **params)
    at = docs.columns.index("text")

    def run(batches):
        of = scorer(model)
        for batch in batches:
            yield batch.filter(pa.array(of(batch.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)


def judge(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    s = score(docs, fit(docs, labels, **params))
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
