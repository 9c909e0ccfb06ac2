"""Suffix-array de-duplication of byte strings by a distributed difference-cover construction.

Removes each byte covered by a string of ``length`` bytes that also starts in a document with a
smaller doc_id.  Suffixes are compared on their first ``length`` bytes only.

Sampling two of three suffixes of a whole corpus would move 16 bytes for each of them, many
times the input.  The sample is therefore taken in two steps:

1. Content-defined sample.  Of the runs of GRAM bytes inside a string of ``length`` bytes the one
   with the smallest hash is its sample position, so equal strings have it at the same offset (the
   property a difference cover has by residues).  Blocks exchange the grams; where a gram occurs
   once, no suffix before it can repeat.
2. Naming.  A sample position stands for all starts that select it; its triple (bytes before the
   gram, gram, bytes after it) is named by a hash, and blocks exchange (name, smallest doc_id).
   A name known to a smaller document covers all its starts at once.  Equal names are carried on
   once, by the smallest document that has them.
3. Suffix array of what differs.  Grams with several names are where matches begin or end.  The
   distinct texts around them meet in the shard of the gram; DC3 sorts all their suffixes
   (triples at positions 1 and 2 modulo 3 are sorted and named, recursion on the names until
   they cover ``length`` bytes, merge of the remaining suffixes), and adjacent suffixes
   with equal prefixes give the smallest document of each string.  The starts found go back.

   A gram with more than ``HOT_TEXTS`` texts (the border of a passage that many documents share,
   each with another context) would fill its shard: there each start's string is named by a
   hash instead, with the smallest document of the block, and meets its equals in the shard of
   that name.

A frequent gram or name is sent once per block; a text around a gram is under
``2 * length`` bytes and sent once.  Grams, names and the strings at hot grams are 64-bit hashes;
the suffixes in step 3 are compared byte by byte.

Texts are UTF-8 bytes; null text has none.  Matches never cross documents.  Repeated rows with
the same doc_id do not count as smaller; a null doc_id is larger than all others.  Overlapping
strings count; all are judged on the input.  An empty table gives no rows; other columns are
ignored.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .phrases import blocks_of
from .recurring import SENT, member, received, recurring, send, shard_of
from .textblocks import (U64, _BYTE_BASE, PrefixHash, as_bytes, covered, mix64, place_of, run_least, slices,
                         with_null_ids)

GRAM = 24
HOT_TEXTS = 8192
SLICE = 1 << 17       # bytes sampled at a time: their arrays stay in a core's cache
RESULT = "doc_id long, n_bytes long, kept binary, spans array<struct<start:long,end:long>>"
NAMES = "shard long, block long, kind int, key binary, value binary"
ANSWER = "block long, kind int, key binary, value binary"


class Samples:
    """Sample positions of the texts of a block and the starts that select them."""

    def __init__(self, pdf: pd.DataFrame, length: int):
        self.texts = texts = as_bytes(pdf["text"])
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.first = np.cumsum(self.size + 1) - self.size - 1       # a byte 0 follows each text
        doc_ids = pdf["doc_id"].to_numpy(np.int64)                  # NO_ID is the largest
        parts = [self._sample(lo, hi, length) for lo, hi in slices(texts, SLICE)]
        kinds = (np.int64, np.int64, U64, U64)
        self.lo, self.hi, self.gram, self.name = (
            np.concatenate([p[i] for p in parts] or [np.zeros(0, k)]) for i, k in enumerate(kinds))
        held = np.diff(np.searchsorted(self.lo, np.concatenate([self.first, [self.size.sum() + len(texts)]])))
        self.doc = np.repeat(doc_ids, held)

    def _sample(self, a: int, b: int, length: int) -> tuple[np.ndarray, ...]:
        """(first start, last start, gram, name) of the samples of texts a..b."""
        size = self.size[a:b] + 1
        data = np.frombuffer(b"\0".join(self.texts[a:b]) + b"\0", np.uint8)
        ph = PrefixHash(data.astype(U64) + U64(1), _BYTE_BASE)
        grams = ph.unmixed(GRAM)
        least = run_least(grams, length - GRAM + 1) if len(data) >= length else grams[:0]
        # a string must not reach the byte behind its text: a run of starts with one sample ends there, too
        inside = np.zeros(len(least) + 2, bool)
        inside[1:-1] = (np.arange(len(least)) + length <= np.repeat(np.cumsum(size) - 1, size)[:len(least)])
        same = np.zeros(len(least) + 1, bool)
        same[1:-1] = least[1:] == least[:-1]
        lo = np.flatnonzero(inside[1:-1] & ~(inside[:-2] & same[:-1]))
        hi = np.flatnonzero(inside[1:-1] & ~(inside[2:] & same[1:]))
        at = place_of(least[lo])
        name = mix64(ph.ranges(lo, hi + length) + (at - lo).astype(U64) * U64(0xA0761D6478BD642F))
        return lo + self.first[a], hi + self.first[a], mix64(grams[at] + U64(GRAM)), name

    def bytes(self) -> bytes:
        """All texts of the block, each with a byte 0 behind it."""
        return b"\0".join(self.texts) + b"\0"

    def strings(self, rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, start, hash of the string there) of every start of the samples ``rows``."""
        n = (self.hi - self.lo + 1)[rows]
        of, start = np.repeat(rows, n), np.repeat(self.lo[rows], n) + _count_up(n)
        data = np.frombuffer(self.bytes(), np.uint8)
        h = np.zeros(len(start), U64)
        for k in range(length):
            h = h * U64(_BYTE_BASE) + data[start + k] + U64(1)
        return of, start, mix64(h)

    def only(self, mask: np.ndarray) -> "Samples":
        for f in ("lo", "hi", "gram", "name", "doc"):
            setattr(self, f, getattr(self, f)[mask])
        return self


def _send_grams(length: int, shards: int):
    def run(pdf):
        return send(int(pdf["block"].iloc[0]), Samples(pdf, length).gram[:, None], shards)
    return run


def _smallest(name: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct names, smallest doc of each, index of a row that has both)."""
    order = np.lexsort((doc, name))
    first = np.concatenate([[True], name[order][1:] != name[order][:-1]]) if len(order) else np.zeros(0, bool)
    rows = order[first]
    return name[rows], doc[rows], rows


def _pack(block: int, kind: int, shard: np.ndarray, key: np.ndarray, value: np.ndarray) -> list[tuple]:
    order = np.argsort(shard, kind="stable")
    shard, key, value = shard[order], key[order], value[order]
    cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(shard) else []
    return [(int(shard[a]), block, kind, key[a:b].tobytes(), value[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:])]


def _send_names(length: int, shards: int):
    """Kind 0: (name, smallest doc); kind 1: (gram, its name, or 0 where the block has several);
    kind 3: (gram, how many names the block has)."""
    def run(pdf, back):
        rows = []
        if len(pdf) and len(back):
            s = Samples(pdf, length)
            s.only(member(s.gram[:, None], received(back, 1)))
            block = int(pdf["block"].iloc[0])
            name, doc, _ = _smallest(s.name, s.doc)
            rows = _pack(block, 0, shard_of(name, shards), name, doc)
            order = np.lexsort((s.name, s.gram))
            gram, names = s.gram[order], s.name[order]
            first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else []
            if len(gram):
                several = names[first] != names[np.concatenate([first[1:], [len(gram)]]) - 1]
                shard = shard_of(gram[first], shards)
                rows += _pack(block, 1, shard, gram[first], np.where(several, U64(0), names[first]))
                new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (names[1:] != names[:-1])])
                rows += _pack(block, 3, shard, gram[first], np.add.reduceat(new.astype(np.int64), first))
        return pd.DataFrame(rows, columns=["shard", "block", "kind", "key", "value"])
    return run


def _answers(block: np.ndarray, kind: int, key: np.ndarray) -> list[tuple]:
    order = np.argsort(block, kind="stable")
    key, block = key[order], block[order]
    cut = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])) if len(block) else []
    return [(int(block[a]), kind, key[a:b].tobytes(), b"") for a, b in zip(cut[:-1], cut[1:])]


def _answer_names(hot_texts: int):
    """Kind 0, 4: names that a smaller document outside the block has; kind 1: grams with several
    names; kind 3: those of them with more than ``hot_texts``."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for kind, g in pdf.groupby("kind"):
            key = np.frombuffer(b"".join(g["key"]), U64)
            block = np.repeat(g["block"].to_numpy(np.int64), [len(k) // 8 for k in g["key"]])
            value = np.frombuffer(b"".join(g["value"]), np.int64)
            order = np.lexsort((value, key))
            key, block, value = key[order], block[order], value[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.concatenate([first, [len(key)]]))
            low = np.repeat(value[first], size)
            if kind in (0, 4):
                keep = value > low
            elif kind == 3:
                keep = np.repeat(np.add.reduceat(value, first) > hot_texts, size)
            else:   # ordered by name: several names, or 0 for several, sort first and last apart
                high = np.repeat(value[first + size - 1], size)
                zero = np.repeat(np.maximum.reduceat((value == 0).astype(np.int8), first), size) > 0
                keep = (low != high) | zero
            out += _answers(block[keep], int(kind), key[keep])
        return pd.DataFrame(out, columns=["block", "kind", "key", "value"])
    return run


def _keys(back: pd.DataFrame, kind: int) -> np.ndarray:
    data = b"".join(back.loc[back["kind"] == kind, "key"]) if len(back) else b""
    return np.sort(np.frombuffer(data, U64))[:, None]


#: one differing text on its way to a shard: name, doc, starts, bytes
_HEAD = np.dtype([("name", "<u8"), ("doc", "<i8"), ("starts", "<u4"), ("size", "<u4")])


def _send_texts(length: int, shards: int):
    """Kind 2: texts; kind 4: (string at a hot gram, smallest doc)."""
    def run(pdf, back):
        rows = []
        mixed = _keys(back, 1)
        if len(pdf) and len(mixed):
            s = Samples(pdf, length)
            s.only(member(s.gram[:, None], mixed))
            known = _keys(back, 0)
            name, doc, row = _smallest(s.name, s.doc)
            own = ~member(name[:, None], known)
            name, doc, row = name[own], doc[own], row[own]
            hot = member(s.gram[row][:, None], _keys(back, 3))
            if hot.any():
                of, _, string = s.strings(row[hot], length)
                string, low, _ = _smallest(string, s.doc[of])
                rows += _pack(int(pdf["block"].iloc[0]), 4, shard_of(string, shards), string, low)
                name, doc, row = name[~hot], doc[~hot], row[~hot]
            head = np.zeros(len(row), _HEAD)
            head["name"], head["doc"] = name, doc
            head["starts"], head["size"] = s.hi[row] - s.lo[row] + 1, s.hi[row] + length - s.lo[row]
            shard = shard_of(s.gram[row], shards)
            order = np.argsort(shard, kind="stable")
            raw = s.bytes()
            cut = np.flatnonzero(np.concatenate([[True], np.diff(shard[order]) != 0, [True]])) if len(order) else []
            for a, b in zip(cut[:-1], cut[1:]):
                part = order[a:b]
                text = b"".join([raw[s.lo[i]:s.hi[i] + length] for i in row[part]])
                rows.append((int(shard[part[0]]), int(pdf["block"].iloc[0]), 2, head[part].tobytes(), text))
        return pd.DataFrame(rows, columns=["shard", "block", "kind", "key", "value"])
    return run


# --- DC3 ------------------------------------------------------------------------------------

def _packed(columns: list[np.ndarray]) -> np.ndarray:
    """One int64 per row in the order of the rows (columns of numbers >= 0)."""
    bits = [int(c.max()).bit_length() if len(c) else 0 for c in columns]
    if sum(bits) <= 63:
        key = columns[0].astype(np.int64)
        for c, b in zip(columns[1:], bits[1:]):
            key = (key << b) | c
        return key
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    key = np.empty(len(order), np.int64)
    key[order] = np.cumsum(new)
    return key


def _ranked(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, name of each row from 1): rows sorted by the columns, equal rows share a name."""
    key = _packed(columns)
    order = np.argsort(key)
    key = key[order]
    name = np.empty(len(order), np.int32)
    name[order] = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])[:len(key)], dtype=np.int32)
    return order.astype(np.int32), name


def _before(own: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """How many rows of ``other`` (in rising order) are smaller than each row of ``own``."""
    key = _packed([np.concatenate(p) for p in zip(other, own)])
    return np.searchsorted(np.maximum.accumulate(key[:len(other[0])]), key[len(other[0]):])


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Start positions in the order of their suffixes' first ``depth`` symbols, by DC3.

    ``text`` holds symbols >= 1.  Names of triples stand for three times as many symbols at each
    level, so the recursion ends when names are unique or cover the depth; suffixes that agree
    so far stay next to each other in any order."""
    n = len(text)
    if n < 3:
        return np.lexsort([np.concatenate([text[k:], np.zeros(k, text.dtype)]) for k in range(max(n, 1))][::-1]) \
            if n else np.zeros(0, np.int64)
    t = np.concatenate([text, np.zeros(3, text.dtype)]).astype(np.int32, copy=False)
    # a position beyond the end completes the class 1 when the length is 1 modulo 3
    sample = np.concatenate([np.arange(1, n + (n % 3 == 1), 3, dtype=np.int32), np.arange(2, n, 3, dtype=np.int32)])
    ones = len(range(1, n + (n % 3 == 1), 3))       # of them at positions 1 modulo 3
    both = lambda x, k: np.concatenate([x[1 + k::3][:ones], x[2 + k::3][:len(sample) - ones]])
    order, name = _ranked([both(t, 0), both(t, 1), both(t, 2)])
    if name.max() < len(sample) and depth > 3:
        sub = suffix_order(name, -(-depth // 3) + 1)
        name = np.empty(len(sub), np.int32)
        name[sub] = np.arange(1, len(sub) + 1, dtype=np.int32)
        order = sub
    rank = np.zeros(n + 4, np.int32)
    rank[1:n + (n % 3 == 1):3], rank[2:n:3] = name[:ones], name[ones:]
    sorted_sample = sample[order]
    sorted_sample = sorted_sample[sorted_sample < n]
    rest = np.arange(0, n, 3, dtype=np.int32)
    rest = rest[np.argsort(_packed([t[:n:3], rank[1::3][:len(rest)]]))]
    # merge: a remaining suffix is compared with a sampled one by one symbol and the ranks behind
    # it, or by two symbols, whichever leads to sampled positions on both sides
    one, two = sorted_sample[sorted_sample % 3 == 1], sorted_sample[sorted_sample % 3 == 2]
    smaller = _before([t[rest], rank[rest + 1]], [t[one], rank[one + 1]]) \
        + _before([t[rest], t[rest + 1], rank[rest + 2]], [t[two], t[two + 1], rank[two + 2]])
    # suffixes that agree to the depth may compare either way: keep the places rising
    place = np.maximum.accumulate(smaller) + np.arange(len(rest))
    out = np.empty(n, np.int32)
    out[place] = rest
    free = np.ones(n, bool)
    free[place] = False
    out[free] = sorted_sample
    return out


def _differ(text: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Whether the string of ``length`` bytes at each place differs from that at the place before."""
    eight = np.ndarray(len(text) + 1, "<u8", np.concatenate([text, np.zeros(8, np.uint8)]).tobytes(), strides=(1,)).copy()
    out = np.zeros(max(0, len(at) - 1), bool)
    for k in range(0, length, 8):
        part = eight[at + k]
        if length - k < 8:
            part &= U64((1 << 8 * (length - k)) - 1)
        out |= part[1:] != part[:-1]
    return out


def smaller_elsewhere(text: np.ndarray, starts: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """Mask of the ``starts`` whose string of ``length`` bytes also starts at one with a smaller
    doc; ``starts`` is rising and every string lies inside ``text``."""
    index = np.full(len(text), -1, np.int32)
    index[starts] = np.arange(len(starts), dtype=np.int32)
    order = index[suffix_order(text.astype(np.int32) + np.int32(1), length)]
    order = order[order >= 0]
    at = starts[order]
    new = np.ones(len(order), bool)
    new[1:] = _differ(text, at, length)
    first = np.flatnonzero(new)
    low = np.repeat(np.minimum.reduceat(doc[order], first), np.diff(np.concatenate([first, [len(order)]]))) if len(first) else doc[order]
    out = np.zeros(len(starts), bool)
    out[order] = doc[order] > low
    return out


def _sort_texts(length: int):
    """A shard's differing texts -> per block (name, bit mask of the starts found smaller); strings
    at hot grams -> those that a smaller document outside the block has."""
    def texts(pdf: pd.DataFrame) -> pd.DataFrame:
        head = np.frombuffer(b"".join(pdf["key"]), _HEAD)
        text = np.frombuffer(b"".join(pdf["value"]), np.uint8)
        block = np.repeat(pdf["block"].to_numpy(np.int64), [len(k) // _HEAD.itemsize for k in pdf["key"]])
        size, count = head["size"].astype(np.int64), head["starts"].astype(np.int64)
        begin = np.cumsum(size) - size
        of = np.repeat(np.arange(len(head)), count)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        found = smaller_elsewhere(text, begin[of] + nth, head["doc"][of].astype(np.int64), length)
        mask = np.zeros(len(head), U64)
        np.bitwise_or.at(mask, of[found], U64(1) << nth[found].astype(U64))
        some = np.flatnonzero(mask)
        some = some[np.argsort(block[some], kind="stable")]
        cut = np.flatnonzero(np.concatenate([[True], np.diff(block[some]) != 0, [True]])) if len(some) else []
        return pd.DataFrame([(int(block[some[a]]), 2, head["name"][some[a:b]].tobytes(), mask[some[a:b]].tobytes())
                             for a, b in zip(cut[:-1], cut[1:])], columns=["block", "kind", "key", "value"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cold = pdf[pdf["kind"] == 2]
        strings = _answer_names(0)(pdf[pdf["kind"] == 4])
        return pd.concat([texts(cold), strings]) if len(cold) else strings
    return run


def _remove(length: int, carried: bool):
    def run(pdf: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({c: [] for c in ("doc_id", "n_bytes", "kept", "spans", "rest")[:4 + carried]})
        s = Samples(pdf, length)
        data = np.frombuffer(s.bytes(), np.uint8)
        gone = np.zeros(len(data), bool)
        if len(s.lo):
            order = np.lexsort((s.doc, s.name))
            name, doc = s.name[order], s.doc[order]
            new = np.concatenate([[True], name[1:] != name[:-1]])
            known = member(name[new][:, None], _keys(back, 0))
            each = np.diff(np.concatenate([np.flatnonzero(new), [len(name)]]))
            whole = np.empty(len(name), bool)
            whole[order] = (doc > np.repeat(doc[new], each)) | np.repeat(known, each)
            lo, hi = [s.lo[whole]], [s.hi[whole] + length]
            part = back[back["kind"] == 2] if len(back) else back
            if len(part):
                key = np.frombuffer(b"".join(part["key"]), U64)
                bits = np.frombuffer(b"".join(part["value"]), U64)
                order = np.argsort(key)
                key, bits = key[order], bits[order]
                at = np.minimum(np.searchsorted(key, s.name), len(key) - 1)
                some = np.flatnonzero((key[at] == s.name) & ~whole)
                n = (s.hi - s.lo + 1)[some]
                nth = _count_up(n)
                on = (np.repeat(bits[at[some]], n) >> nth.astype(U64)) & U64(1)
                begin = (np.repeat(s.lo[some], n) + nth)[on > 0]
                lo.append(begin)
                hi.append(begin + length)
            hot = np.flatnonzero(member(s.gram[:, None], _keys(back, 3)))
            if len(hot):
                of, begin, string = s.strings(hot, length)
                known, first, _ = _smallest(string, s.doc[of])
                on = (s.doc[of] > first[np.searchsorted(known, string)]) | member(string[:, None], _keys(back, 4))
                lo.append(begin[on])
                hi.append(begin[on] + length)
            gone = covered(len(data), np.concatenate(lo), np.concatenate(hi))
        kept, spans = [], []
        for t, (a, n) in enumerate(zip(s.first, s.size)):
            g = gone[a:a + n]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], g.view(np.int8), [0]])))
            kept.append(data[a:a + n][~g].tobytes() if len(edge) else s.texts[t])
            spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edge[0::2], edge[1::2])])
        out = {"doc_id": pdf["doc_id"], "n_bytes": s.size, "kept": kept, "spans": spans}
        return pd.DataFrame(out | ({"rest": pdf["rest"]} if carried else {}))
    return run


def _count_up(n: np.ndarray) -> np.ndarray:
    """0, 1, .., n_0 - 1, 0, 1, .., n_1 - 1, ..."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _differing(by_block, length: int, blocks: int, hot_texts: int) -> tuple[DataFrame, DataFrame]:
    """(answers about names and grams, texts and strings on their way to the shards)"""
    grams = recurring(by_block.applyInPandas(_send_grams(length, blocks), SENT), 1)
    names = by_block.cogroup(grams.groupBy("block")).applyInPandas(_send_names(length, blocks), NAMES)
    known = names.groupBy("shard").applyInPandas(_answer_names(hot_texts), ANSWER)
    return known, by_block.cogroup(known.groupBy("block")).applyInPandas(_send_texts(length, 4 * blocks), NAMES)


def remove_repeats(docs: DataFrame, length: int = 50, block_bytes: int = 6 << 20,
                   carry: tuple[str, ...] = (), hot_texts: int = HOT_TEXTS) -> DataFrame:
    """doc_id, n_bytes, kept (remaining bytes), spans (maximal removed runs of bytes), and the
    struct ``rest`` of the columns to carry, if any."""
    if not GRAM < length <= GRAM + 63:
        raise ValueError("length out of range")
    d, blocks = blocks_of(docs, block_bytes, carry)
    by_block = d.groupBy("block")
    known, texts = _differing(by_block, length, blocks, hot_texts)
    found = texts.groupBy("shard").applyInPandas(_sort_texts(length), ANSWER)
    result = RESULT + (f", rest {d.schema['rest'].dataType.simpleString()}" if carry else "")
    answers = known.where("kind in (0, 3)").unionByName(found)
    return with_null_ids(by_block.cogroup(answers.groupBy("block")).applyInPandas(_remove(length, bool(carry)), result))
