"""Benchmark decontamination by spaced-seed hashing.

Fixed masks choose some positions of a run of words and ignore the others, so a seed survives
substitutions at the ignored places.  The seeds of all benchmark items form a hash index; the
seeds of every training text are looked up in it (a map-side join), and around each hit the
overlap is verified on its diagonal: word by word against the item, +1 for an equal and -2 for
a substituted word, best run.  A run that scores ``min_score`` is an overlap: 12 equal words in a
row, or 20 words with two or three substitutions.  Items shorter than the masks are found as a
whole, if they have ``min_words`` words.

Words are runs of letters and digits, A-Z lower-cased; ASCII punctuation separates.  The
texts are not shuffled.  The index holds at most ``index_words`` words of benchmark text; a
larger benchmark is taken in several such parts, each over all texts.

Defined cases: null texts have no words; a null doc_id is kept as null; repeated rows are
reported as often as they occur; an empty table on either side gives no rows; other columns
are ignored.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textblocks import U64, Words, as_bytes, filled_id, mix64, slices, with_null_ids, words_of

#: spaced masks over 12 words, 8 of them compared
MASKS = ("110100110111", "111010110011", "101101110101")
SCHEMA = "doc_id long, item_id long, seeds int, word_start long, n_words int, n_equal int, char_start long, char_end long"
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_SUBSTITUTED = -2


def plain_words(texts: list[bytes]) -> Words:
    return words_of([t.translate(_PLAIN) for t in texts])


def _inside(w: Words, span: int) -> np.ndarray:
    last = np.repeat(w.first[1:], np.diff(w.first))
    return np.flatnonzero(np.arange(len(w.hash)) + span <= last)


def seed_hashes(w: Words, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word position) of the mask at every place inside a text."""
    at = _inside(w, len(mask))
    salt = U64(int(mask, 2) * 0x9E3779B97F4A7C15 & (2 ** 64 - 1))
    h = np.full(len(at), salt, U64)
    for j, c in enumerate(mask):
        if c == "1":
            h = h * U64(0xD6E8FEB86659FD93) + w.hash[at + j]
    return mix64(h), at


class SeedIndex:
    """Seeds of some items: a bit table for a first look, then sorted hashes."""

    BITS = 22

    def __init__(self, item_ids: list[int], texts: list[bytes], min_words: int):
        w = plain_words(texts)
        n = np.diff(w.first)
        self.item_ids = np.array(item_ids, np.int64)
        self.words, self.first = w.hash, w.first
        shortest = min(map(len, MASKS))
        self.masks = list(MASKS) + ["1" * k for k in sorted(set(n[(n >= min_words) & (n < shortest)].tolist()))]
        hs, ps = [], []
        for m in self.masks:
            h, at = seed_hashes(w, m)
            if len(m) < shortest:      # only whole short items
                whole = n[w.text_of[at]] == len(m)
                h, at = h[whole], at[whole]
            hs.append(h)
            ps.append(at)
        h, p = (np.concatenate(hs), np.concatenate(ps)) if hs else (np.zeros(0, U64), np.zeros(0, np.int64))
        order = np.argsort(h, kind="stable")
        self.hash, self.pos = h[order], p[order]
        self.item_of = w.text_of
        self.table = np.zeros(1 << self.BITS, bool)
        self.table[(self.hash >> U64(64 - self.BITS)).astype(np.int64)] = True

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(text word, item word) of every seed in common."""
        tw, iw = [], []
        for m in self.masks:
            h, at = seed_hashes(w, m)
            maybe = np.flatnonzero(self.table[(h >> U64(64 - self.BITS)).astype(np.int64)])
            lo = np.searchsorted(self.hash, h[maybe], "left")
            n = np.searchsorted(self.hash, h[maybe], "right") - lo
            k = np.repeat(np.arange(len(maybe)), n)
            nth = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
            tw.append(at[maybe[k]])
            iw.append(self.pos[lo[k] + nth])
        return (np.concatenate(tw), np.concatenate(iw)) if tw else (np.zeros(0, np.int64),) * 2

    def overlaps(self, w: Words, min_score: int):
        """(text, item, seeds, first word, words, equal words) of verified overlaps, the best of
        each (text, item)."""
        tw, iw = self.hits(w)
        if not len(tw):
            return []
        text, item = w.text_of[tw], self.item_of[iw]
        keys, seeds = np.unique(np.stack([text, item, tw - iw], 1), axis=0, return_counts=True)
        best: dict[tuple[int, int], tuple] = {}
        for lo in range(0, len(keys), 20_000):
            self._verify(w, keys[lo:lo + 20_000], seeds[lo:lo + 20_000], min_score, best)
        return list(best.values())

    def _verify(self, w: Words, keys, seeds, min_score: int, best: dict) -> None:
        text, item, shift = keys.T
        # the part of the item that lies inside the text on this diagonal
        a = np.maximum(self.first[item], w.first[text] - shift)
        b = np.minimum(self.first[item + 1], w.first[text + 1] - shift)
        n = b - a
        seg = np.repeat(np.arange(len(keys)), n)
        begin = np.cumsum(n) - n
        at = np.arange(n.sum()) - begin[seg] + a[seg]
        equal = w.hash[at + shift[seg]] == self.words[at]
        run = np.cumsum(np.where(equal, 1, _SUBSTITUTED))
        before = np.concatenate([[0], run[:-1]])
        drop = seg * (4 * len(run) + 8)       # makes the running minimum begin anew in each diagonal
        low = np.minimum.accumulate(before - drop) + drop
        score = np.maximum.reduceat(run - low, begin)
        need = np.minimum(min_score, self.first[item + 1] - self.first[item])
        for c in np.flatnonzero(score >= need):
            s = slice(begin[c], begin[c] + n[c])
            end = int(np.argmax((run - low)[s]))
            start = int(np.flatnonzero(before[s][:end + 1] == low[s][end])[-1])
            size = end - start + 1
            same = int(equal[s][start:end + 1].sum())
            key = (int(text[c]), int(item[c]))
            found = (*key, int(seeds[c]), int(a[c] + start + shift[c]), size, same, int(score[c]))
            if key not in best or found[-1] > best[key][-1]:
                best[key] = found


def index_parts(benchmark: DataFrame, index_words: int) -> list[DataFrame]:
    """Items in parts of at most about ``index_words`` words (hash of the item)."""
    b = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    total = b.agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).first()["n"] or 0
    parts = max(1, -(-int(total) // index_words))
    part = F.pmod(F.xxhash64("item_id"), F.lit(parts))
    return [b.where(part == i) for i in range(parts)]


def _indexes(benchmark: DataFrame, min_words: int, index_words: int):
    """A broadcast index for each part of the benchmark."""
    for part in index_parts(benchmark, index_words):
        items = part.distinct().orderBy("item_id", "text").collect()
        index = SeedIndex([r["item_id"] for r in items], as_bytes([r["text"] for r in items]), min_words)
        yield benchmark.sparkSession.sparkContext.broadcast(index)


def overlaps(docs: DataFrame, benchmark: DataFrame, min_score: int = 12, min_words: int = 8,
             index_words: int = 1_000_000) -> DataFrame:
    """One row per (document row, item) with a verified overlap: its place in words and bytes."""
    source = docs.select(filled_id(), "text").where("text is not null")
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    out = None
    for shared in _indexes(benchmark, min_words, index_words):
        def find(batches, shared=shared):
            ix = shared.value
            for pdf in batches:
                texts, keys = as_bytes(pdf["text"]), pdf["doc_id"].tolist()
                for lo, hi in slices(texts):
                    w = plain_words(texts[lo:hi])
                    base = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[lo:hi]])])
                    rows = [(keys[lo + t], int(ix.item_ids[i]), seeds, at - int(w.first[t]), n, same,
                             int(w.start[at] - base[t]), int(w.end[at + n - 1] - base[t]))
                            for t, i, seeds, at, n, same, _ in ix.overlaps(w, min_score)]
                    if rows:
                        yield pd.DataFrame(rows, columns=names)

        found = source.mapInPandas(find, SCHEMA)
        out = found if out is None else out.unionByName(found)
    return with_null_ids(out)


def clean(docs: DataFrame, benchmark: DataFrame, min_score: int = 12, min_words: int = 8,
          index_words: int = 1_000_000) -> DataFrame:
    """The rows of docs, with all their columns, that overlap no item."""
    at = docs.columns.index("text")
    for shared in _indexes(benchmark, min_words, index_words):
        def keep(batches, shared=shared):
            for batch in batches:
                texts = as_bytes(batch.column(at).to_pylist())
                good = np.ones(len(texts), bool)
                for lo, hi in slices(texts):
                    for found in shared.value.overlaps(plain_words(texts[lo:hi]), min_score):
                        good[lo + found[0]] = False
                yield batch.filter(pa.array(good))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
