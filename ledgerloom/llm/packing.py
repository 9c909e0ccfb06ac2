"""Packing: documents to token pieces, pieces to windows by multiway number differencing.

1. ``token_pieces``: every document is tokenised once (Arrow batches, whole texts) and cut
   into full pieces of ``capacity`` ids and one shorter rest.
2. ``pack_pieces``: pieces are dealt into groups of about ``group_bytes`` of text, and of about
   ``group_rows`` rows, by a hash of the document's id and ids, salted with the number of equal rows
   before it in its task (neither a hot source nor repeated rows meet in one group, and a task that
   runs again on the same rows in another order deals the same).  A full piece is a window of its
   own.  The rests of a group are split over k = ceil(sum / capacity) windows by
   Karmarkar-Karp differencing: partial partitions (lists of k window sums) are merged, the one
   with the largest imbalance first, the large sums of one on the small sums of the other.  If
   the fullest window exceeds the capacity, k grows and the differencing runs again.

Defined cases: null text is the empty text (only the end id); an empty table gives no rows;
repeated rows are packed like different rows; further columns are ignored.
"""
from __future__ import annotations

import heapq
import os
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textblocks import filled_id, with_null_ids

CAPACITY = 2048
PIECE_SCHEMA = "doc_id long, start long, length long, doc_tokens long, ids binary, grp long"
PACKED_SCHEMA = "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long"

_LOADED: dict[str, "PieceEncoder"] = {}


class PieceEncoder:
    """Ids of a text, by the byte-level vocabulary file of the ``tokenizers`` library, as little-endian
    uint32 bytes.

    The file is loaded by ``tokenizers``.  Its vocabulary (ids in the order of the merges) is handed to
    ``tiktoken``, which gives the same ids in a quarter of the time.  Texts with a letter beyond Latin
    Extended-B or unusual white space, where the two regex dialects could differ, go through
    ``tokenizers`` itself; so does everything if the two disagree on ``PROBE``."""

    # The published byte-level pre-tokenisation pattern.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    PROBE = "Don't stop: it's 12,345.67 – naïve café\n\n  two  blanks <|endoftext|> <s> \t x__y ÿĀž aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa "
    _UNUSUAL = re.compile("[\x1c-\x1f\x85\xa0\u0250-\U0010ffff]")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        letters = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        special = self.tok.get_added_tokens_decoder()
        ranks = {bytes(letters[c] for c in t): i for t, i in self.tok.get_vocab().items() if i not in special}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        if self.fast.encode_ordinary(self.PROBE) != self.tok.encode(self.PROBE, add_special_tokens=False).ids:
            self.fast = None

    def ids(self, text: str) -> list[int]:
        if self.fast is None or self._UNUSUAL.search(text):
            return self.tok.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def encode(self, text: str) -> bytes:
        return np.array(self.ids(text), "<u4").tobytes()


def encoder(path: str) -> PieceEncoder:
    if path not in _LOADED:
        _LOADED[path] = PieceEncoder(path)
    return _LOADED[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, groups: int, end_id: int = 1,
                 capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id (NO_ID for null), start, length, doc_tokens, ids (little-endian
    uint32), grp."""

    def cut(batches):
        enc = encoder(tokenizer_path)
        tail = np.array([end_id], "<u4").tobytes()
        equal: dict[tuple[int, int], int] = {}
        for pdf in batches:
            rows: list[tuple] = []
            keys, texts = pdf["doc_id"].tolist(), [t if isinstance(t, str) else "" for t in pdf["text"]]
            for key, text in zip(keys, texts):
                ids = enc.encode(text) + tail
                n = len(ids) // 4
                name = (key, zlib.crc32(ids))
                equal[name] = again = equal.get(name, 0) + 1
                salt = zlib.crc32(b"%d %d %d" % (*name, again))
                for k, s in enumerate(range(0, n, capacity)):
                    rows.append((key, s, min(capacity, n - s), n, ids[4 * s:4 * (s + capacity)],
                                 zlib.crc32(k.to_bytes(8, "little"), salt) % groups))
                if len(rows) >= 512:
                    yield _frame(rows)
                    rows = []
            if rows:
                yield _frame(rows)

    def _frame(rows):
        return pd.DataFrame(rows, columns=["doc_id", "start", "length", "doc_tokens", "ids", "grp"])

    return docs.select(filled_id(), "text").mapInPandas(cut, PIECE_SCHEMA)


def difference(sizes: np.ndarray, windows: int) -> np.ndarray:
    """Window number of each size by multiway differencing into ``windows`` windows.

    A partial partition is (its window sums in falling order, the tree node of each window);
    only windows that hold something are kept.  Nodes >= len(sizes) join two older nodes."""
    n = len(sizes)
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    count = n
    heap = [(-int(s), i, np.array([s], np.int64), np.array([i], np.int64)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    turn = n
    while len(heap) > 1:
        _, _, a, na = heapq.heappop(heap)
        _, _, b, nb = heapq.heappop(heap)
        over = len(a) + len(b) - windows
        if over > 0:        # the smallest sums of a, in rising order, on the smallest of b, in falling order
            ia = np.arange(len(a) - over, len(a))
            ib = windows - 1 - ia
            joined = a[ia] + b[ib]
            left.append(na[ia])
            right.append(nb[ib])
            nj = np.arange(count, count + over)
            count += over
            sums = np.concatenate([a[:len(a) - over], b[:len(b) - over], joined])
            nodes = np.concatenate([na[:len(a) - over], nb[:len(b) - over], nj])
        else:
            sums, nodes = np.concatenate([a, b]), np.concatenate([na, nb])
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        spread = int(sums[0] - (sums[-1] if len(sums) == windows else 0))
        heapq.heappush(heap, (-spread, turn, sums, nodes))
        turn += 1
    roots = heap[0][3]
    owner = np.full(count, -1, np.int64)
    owner[roots] = np.arange(len(roots))
    if left:
        lo, hi = np.concatenate(left), np.concatenate(right)
        for j in range(count - n - 1, -1, -1):      # newest join first: parents before children
            owner[lo[j]] = owner[hi[j]] = owner[n + j]
    return owner[:n]


def split_windows(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """(window of each size, number of windows): as few windows as differencing can fill."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        at = difference(sizes, k)
        fullest = int(np.bincount(at, sizes, minlength=k).max())
        if fullest <= capacity:
            return at, k
        k += max(1, k // 128)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset (gapless from 0 in each sequence) to every piece."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        base = int(pdf["grp"].iloc[0]) << 32
        pdf = pdf.sort_values(["doc_id", "start"], kind="stable").reset_index(drop=True)
        size = pdf["length"].to_numpy(np.int64)
        seq = np.zeros(len(pdf), np.int64)
        full = size >= capacity
        seq[full] = np.arange(full.sum())
        if (~full).any():
            at, _ = split_windows(size[~full], capacity)
            seq[~full] = int(full.sum()) + at
        order = np.argsort(seq, kind="stable")
        so, ss = size[order], seq[order]
        before = np.cumsum(so) - so
        first = np.concatenate([[True], ss[1:] != ss[:-1]])
        offset = np.zeros(len(pdf), np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
        pdf["sequence_id"], pdf["offset"] = base + seq, offset
        return pdf[["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"]]

    return with_null_ids(pieces.groupBy("grp").applyInPandas(pack, PACKED_SCHEMA))


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY,
                   group_rows: int = 1024, group_bytes: int = 4 << 20) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most ``capacity`` ids."""
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("b")).first()
    groups = max(1, -(-size["n"] // group_rows), -(-(size["b"] or 0) // group_bytes))
    return pack_pieces(token_pieces(docs, tokenizer_path, groups, end_id, capacity), capacity)
