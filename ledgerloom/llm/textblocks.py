"""Blocks of whole documents and vectorised hashing of their words and bytes.

A *block* is a set of documents (hash of the document key) of a few MB of text: the unit in
which operators look at texts with numpy.  The number of blocks follows the total size of the
texts, so one block stays bounded whatever the table size (a single larger document is a block
of its own size).

Hashes are polynomial prefix sums modulo 2^64 followed by a bit mixer, so the hash of every
window of a text costs a few vector operations, independent of the window length.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import free_shuffles, passing_shuffles  # noqa: F401

U64 = np.uint64
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93
_SECOND_BASE = 0xA0761D6478BD642F
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        p = np.full(size, base, U64)
        p[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(p)
    return have[:n]


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix64(z: np.ndarray) -> np.ndarray:
    """Bijective bit mixer on uint64 arrays."""
    z = (z ^ (z >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U64(27))) * U64(0x94D049BB133111EB)
    return z ^ (z >> U64(31))


class PrefixHash:
    """Hashes of arbitrary ranges of one uint64 symbol sequence."""

    def __init__(self, symbols: np.ndarray, base: int):
        n = len(symbols)
        self.base = base
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(symbols * _powers(base, n), out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        inv = _powers(_inverse(self.base), len(self.sums))
        return mix64((self.sums[end] - self.sums[start]) * inv[start] + U64(0x632BE59BD9B4E019) * (end - start).astype(U64))

    def windows(self, k: int) -> np.ndarray:
        """Hash of every window of k symbols (empty when there are fewer)."""
        return mix64(self.unmixed(k) + U64(k))

    def unmixed(self, k: int) -> np.ndarray:
        """The same before the bits are mixed (its upper half alone is good for an order)."""
        m = len(self.sums) - k
        if m <= 0:
            return np.zeros(0, U64)
        inv = _powers(_inverse(self.base), len(self.sums))
        return (self.sums[k:] - self.sums[:-k]) * inv[:m]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@dataclass
class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a list of texts, one after another."""

    data: np.ndarray          # bytes of all texts, one blank after each
    start: np.ndarray         # first byte of each word
    end: np.ndarray           # byte after each word
    first: np.ndarray         # index of each text's first word; one more entry at the end
    text_of: np.ndarray       # index of each word's text
    hash: np.ndarray          # 64-bit hash of each word


def words_of(texts: list[bytes], lower: bool = False) -> Words:
    """``lower`` maps A-Z to a-z before hashing (other letters unchanged)."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    if not len(texts):
        bounds = np.zeros(1, np.int64)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    ph = PrefixHash(data.astype(U64) + U64(1), _BYTE_BASE)
    h = ph.ranges(start, end) if len(start) else np.zeros(0, U64)
    first = np.searchsorted(start, bounds)
    text_of = np.repeat(np.arange(len(texts)), np.diff(first)) if len(texts) else np.zeros(0, np.int64)
    return Words(data, start, end, first, text_of, h)


def word_windows(w: Words, k: int, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash, inside) of the window of k words that starts at each word; ``inside`` is False
    where the window would cross into the next text.  ``second`` picks an independent hash."""
    n = len(w.hash)
    sym = mix64(w.hash ^ U64(0x5851F42D4C957F2D)) if second else w.hash
    h = np.zeros(n, U64)
    got = PrefixHash(sym, _SECOND_BASE if second else _WORD_BASE).windows(k)
    h[:len(got)] = got
    inside = np.zeros(n, bool)
    if n:
        last = np.repeat(w.first[1:], np.diff(w.first))
        inside = np.arange(n) + k <= last
    return h, inside


def minima(h: np.ndarray, seg: np.ndarray, width: int) -> np.ndarray:
    """Winnowing: mask of the positions that hold the (right-most) smallest value of some run
    of ``width`` consecutive positions of the same segment.  ``seg`` is the non-decreasing
    segment number of each position; a segment shorter than ``width`` marks nothing."""
    n = len(h)
    keep = np.zeros(n, bool)
    if n < width:
        return keep
    at = run_argmin(h, width)
    same = seg[: n - width + 1] == seg[width - 1:]
    keep[at[same]] = True
    return keep


def run_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the right-most smallest value of each run of ``width`` values."""
    val, pos, span = h, np.arange(len(h)), 1
    while span < width:
        step = min(span, width - span)
        right = val[step:] <= val[:-step]
        pos = np.where(right, pos[step:], pos[:-step])
        val = np.where(right, val[step:], val[:-step])
        span += step
    return pos


_LOW = U64(0xFFFFFFFF)


def run_least(h: np.ndarray, width: int) -> np.ndarray:
    """(upper half of h, position): of each run of ``width`` values the right-most with the smallest upper
    half, packed into one number (see :func:`place_of`).  Positions must fit into 32 bits."""
    val = (h & ~_LOW) | (_LOW - np.arange(len(h), dtype=U64))
    span = 1
    while span < width:
        step = min(span, width - span)
        val = np.minimum(val[step:], val[:-step])
        span += step
    return val


def place_of(least: np.ndarray) -> np.ndarray:
    """Positions of what :func:`run_least` found."""
    return (_LOW - (least & _LOW)).astype(np.int64)


def cover(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Mask of the positions covered by runs of ``length`` from each start."""
    return covered(n, starts, np.minimum(starts + length, n))


def covered(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Mask of the positions covered by the ranges lo..hi - 1."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, lo, 1)
    np.add.at(d, hi, -1)
    return np.cumsum(d[:-1], dtype=np.int32) > 0


#: stands for a null id in Python code, where a column with nulls would turn into floats
NO_ID = 2 ** 63 - 1


def filled_id(column: str = "doc_id"):
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID)).alias(column)


def with_null_ids(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) != NO_ID, F.col(c)) for c in columns or ("doc_id",)})


def as_bytes(values) -> list[bytes]:
    """UTF-8 bytes of a pandas column of texts; null is the empty text."""
    return [v.encode("utf-8", "surrogatepass") if isinstance(v, str) else b"" for v in values]


def slices(texts: list[bytes], most: int = 1 << 20):
    """(lo, hi) of consecutive texts with about ``most`` bytes together: what is looked at at a
    time, so that working arrays stay small beside the block."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= most):
            size += len(texts[hi])
            hi += 1
        yield lo, hi
        lo = hi


def block_count(texts: DataFrame, column: str, block_bytes: int) -> int:
    """Blocks of about ``block_bytes`` of text (one cheap aggregate over the column)."""
    total = texts.agg(F.sum(F.octet_length(F.col(column)).cast("long")).alias("b")).first()["b"]
    return max(1, -(-int(total or 0) // block_bytes))
