"""Substring de-duplication of recurring word passages by repeated-phrase automata.

A passage is a window of ``window`` words whose sequence starts at two places or more.

1. Anchors.  Of every ``window - ANCHOR + 1`` consecutive runs of ANCHOR words the smallest by
   hash is an anchor; equal windows have equal anchors, so a window can only recur if its
   anchor does.  Blocks exchange their distinct anchors (``recurring``).
2. Confirmation.  Blocks send a 128-bit hash of every window with a recurring anchor; those that
   occur twice come back.
3. Automata.  Each block is a shard: its confirmed passages, every text of them once, are cut
   into pieces so that any window in them holds a whole piece, and the pieces are compiled into
   an Aho-Corasick automaton.  All texts of the block stream through it; at each occurrence the
   windows around it are compared with the confirmed ones, and their words are covered.

The automaton of a shard is bounded by the text of its block, the exchanges by the number of
anchors and candidate windows; a passage in a third of all texts reaches a shard once per block.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  Null text has no words; texts shorter than the
window keep all; repeated rows are copies of each other (each row is a place of its own); rows
with a null doc_id are kept as such; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

from itertools import compress

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .recurring import SENT, member, received, recurring, send
from .textblocks import (Words, as_bytes, block_count, cover, filled_id, run_argmin, with_null_ids, word_windows,
                         words_of)

ANCHOR = 16
RESULT = "doc_id long, n_words long, kept string, spans array<struct<start:long,end:long>>"


def _anchors(w: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the run of words at each place, window starts, anchor place of each window)."""
    h, _ = word_windows(w, ANCHOR)
    n = len(h)
    start = np.flatnonzero(np.arange(n) + window <= np.repeat(w.first[1:], np.diff(w.first))) if n else np.zeros(0, np.int64)
    if not len(start):
        return h, start, start
    return h, start, run_argmin(h, window - ANCHOR + 1)[start]


def _send_anchors(window: int, shards: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, _, at = _anchors(words_of(as_bytes(pdf["text"])), window)
        return send(int(pdf["block"].iloc[0]), h[np.unique(at)][:, None], shards)
    return run


def _send_windows(window: int, shards: int):
    def run(pdf: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(back):
            return send(0, np.zeros((0, 2), np.uint64), shards)
        w = words_of(as_bytes(pdf["text"]))
        h, start, at = _anchors(w, window)
        start = start[member(h[at][:, None], received(back, 1))]
        return send(int(pdf["block"].iloc[0]), _window_keys(w, window)[start], shards)
    return run


def _window_keys(w: Words, window: int) -> np.ndarray:
    return np.stack([word_windows(w, window)[0], word_windows(w, window, second=True)[0]], 1)


def compile_automaton(texts: list[bytes], w: Words, window: int, starts: np.ndarray, keys: np.ndarray):
    """Automaton of the pieces of the passages that begin at ``starts``; each distinct window
    (row of ``keys``) is taken where it is first."""
    piece = (window + 1) // 2
    first = np.unique(np.unique(keys, axis=0, return_index=True)[1])
    starts = starts[first]
    run = np.cumsum(np.concatenate([[True], np.diff(starts) != 1]))
    auto = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    words: dict[int, list[bytes]] = {}
    for group in np.split(starts, np.flatnonzero(np.diff(run)) + 1):
        t = int(w.text_of[group[0]])
        if t not in words:
            words = {t: texts[t].split()}
        a = int(group[0] - w.first[t])
        end = int(group[-1] - w.first[t]) + window
        for p in range(a, end - piece + 1, piece):
            auto.add_word((b" " + b" ".join(words[t][p:p + piece]) + b" ").decode("latin-1"))
    auto.make_automaton()
    return auto, piece


def _remove(window: int):
    def run(pdf: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"doc_id": [], "n_words": [], "kept": [], "spans": []})
        texts = as_bytes(pdf["text"])
        w = words_of(texts)
        covered = np.zeros(len(w.hash), bool)
        if len(back):
            keys = _window_keys(w, window)
            _, start, at = _anchors(w, window)
            confirmed = received(back, 2)
            good = start[member(keys[start], confirmed)]
            if len(good):
                auto, piece = compile_automaton(texts, w, window, good, keys[good])
                found = np.zeros(len(w.hash), bool)
                for t, text in enumerate(texts):
                    line = b" " + b" ".join(text.split()) + b" "
                    ends = np.fromiter((e for e, _ in auto.iter(line.decode("latin-1"))), np.int64)
                    if len(ends):       # a match ends on the blank after its last word
                        blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
                        found[w.first[t] + np.searchsorted(blanks, ends) - piece] = True
                near = np.unique((np.flatnonzero(found)[:, None] - np.arange(window - piece + 1)).ravel())
                near = near[near >= 0]
                near = near[near + window <= w.first[w.text_of[near] + 1]]
                covered = cover(len(w.hash), near[member(keys[near], confirmed)], window)
        kept, spans = [], []
        for t, text in enumerate(texts):
            a, b = w.first[t], w.first[t + 1]
            gone = covered[a:b]
            words = text.split()
            kept.append((b" ".join(compress(words, ~gone)) if gone.any() else b" ".join(words)).decode("utf-8", "replace"))
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
            spans.append([{"start": int(s), "end": int(e)} for s, e in zip(edge[0::2], edge[1::2])])
        return pd.DataFrame({"doc_id": pdf["doc_id"], "n_words": np.diff(w.first), "kept": kept, "spans": spans})
    return run


def blocks_of(docs: DataFrame, block_bytes: int, carry: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """(doc_id, text, block), dealt by block, and the number of blocks; columns to ``carry`` are
    kept in one struct ``rest``.  A null doc_id is NO_ID."""
    n = block_count(docs, "text", block_bytes)
    rest = [F.struct(*carry).alias("rest")] if carry else []
    d = docs.select(filled_id(), F.coalesce("text", F.lit("")).alias("text"), *rest)
    d = d.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)))
    return d.repartition(n, "block"), n


def remove_passages(docs: DataFrame, window: int = 35, block_bytes: int = 6 << 20) -> DataFrame:
    """doc_id, n_words, kept (words that stay, joined by blanks), spans (removed runs of words)."""
    d, blocks = blocks_of(docs, block_bytes)
    by_block = d.groupBy("block")
    anchors = recurring(by_block.applyInPandas(_send_anchors(window, blocks), SENT), 1)
    windows = by_block.cogroup(anchors.groupBy("block")).applyInPandas(_send_windows(window, blocks), SENT)
    confirmed = recurring(windows, 2)
    return with_null_ids(by_block.cogroup(confirmed.groupBy("block")).applyInPandas(_remove(window), RESULT))
