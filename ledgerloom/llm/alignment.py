"""Cross-tokenizer alignment by sparse incidence matrices.

Two tokenizers cut the bytes of the same line (a blank and the text).  Token-byte incidence
matrices A and B are built by hand in compressed sparse rows; the row products A * B^T (for each
row of A the rows of B^T that its entries name are merged, Gustavson's order) have an entry for
every pair of tokens whose byte ranges overlap.  Byte offsets where tokens of both sides end cut
the line into groups; the product of the group incidences GA * GB^T links tokens of one group.

A line is cut into *chunks* before single blanks between plain letters, digits or signs; there
neither tokenizer joins what lies on both sides (tested against whole lines), so matrices are
built for the distinct chunks of a block of documents and a document's result is the sum over
its chunks.  A document with a chunk that a tokenizer does not give back is taken as one chunk.

Blocks are runs of scanned documents of a few MB; texts are read once and never shuffled.  What
is kept of a block is one row: its documents' numbers, and their id pairs as one more product,
documents x chunks * chunks x pairs, in compressed sparse rows over the pairs of the block.  The
number of documents that hold a pair: Spark sums the blocks' numbers, finds the highest of each
A id and joins both back to the blocks that hold the pair, a table per block, never one for all.

Defined cases: a text that is null or empty, or whose line one of the tokenizers does not give
back byte by byte, has no tokens: zeros and an empty ``groups_sha256``.  Repeated rows are
documents of their own; null doc_ids stay; an empty table gives no rows; other columns are
ignored.  Strings of special tokens inside a text are plain text.
"""
from __future__ import annotations

import hashlib
import re
import zlib
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .packing import encoder
from .textblocks import filled_id, with_null_ids

NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_group_links")
#: packed arrays: ids and numbers of the documents, digests, pairs (keys) with their documents, and
#: the documents x pairs matrix (pointers, pair numbers, links of the pair)
BLOCK = ("block long, doc_id binary, numbers binary, digests binary, keys binary, docs binary, ptr binary, "
         "col binary, value binary")
PAIRS = "block long, a long, b long, docs long"
BACK = "block long, n binary, best binary"
RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_group_links long, n_best long, "
          "count_sum long, groups_sha256 string")
#: no boundary between chunks unless both neighbours of the blank are of these
_PLAIN = "!-~À-ɏ"
_ODD = re.compile(f"^ | $|[^{_PLAIN}] | [^{_PLAIN}]")
_BOUNDARY = re.compile(f"(?<=[{_PLAIN}])(?= [{_PLAIN}])")

_LOADED: dict[tuple[str, str], "Tokenizers"] = {}


class Tokenizers:
    """A byte-level vocabulary file (A) and a sentence-piece model (B) with the bytes of their ids."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        self.a = encoder(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [x for x in range(256) if x not in printable]
        byte = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(others)}
        spelt = sorted((i, t) for t, i in self.a.tok.get_vocab(with_added_tokens=True).items())
        self.bytes_a = [b""] * (spelt[-1][0] + 1)
        for i, t in spelt:
            self.bytes_a[i] = bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i)
                                else piece.replace("▁", " ").encode())
        self.name_a, self.name_b = ([str(i) for i in range(len(x))] for x in (self.bytes_a, self.bytes_b))
        self.size_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)

    def encode(self, lines: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of lines that begin with a blank (which B adds by itself)."""
        return [self.a.ids(x) for x in lines], self.b.encode([x[1:] for x in lines], num_threads=1)


def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = Tokenizers(path_a, path_b)
    return _LOADED[path_a, path_b]


def expand(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... of ``sizes[0]`` numbers, then those of the next, ..."""
    total = int(sizes.sum())
    ends = np.cumsum(sizes)
    return np.arange(total) - np.repeat(ends - sizes, sizes) + np.repeat(starts, sizes)


def row_products(a_ptr: np.ndarray, a_col: np.ndarray, b_ptr: np.ndarray, b_col: np.ndarray, width: int):
    """(ptr, col, value) of the product of two 0/1 matrices in compressed sparse rows: the entries
    of each row of A name rows of B, which are merged.  ``width``: columns of B."""
    sizes = b_ptr[a_col + 1] - b_ptr[a_col]
    rows = np.repeat(np.repeat(np.arange(len(a_ptr) - 1), np.diff(a_ptr)), sizes)
    cells, value = np.unique(rows * width + b_col[expand(b_ptr[a_col], sizes)], return_counts=True)
    ptr = np.searchsorted(cells, np.arange(len(a_ptr)) * width)
    return ptr, cells % width, value


def transposed(ptr: np.ndarray, col: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(col, kind="stable")
    rows = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    return np.searchsorted(col[order], np.arange(width + 1)), rows[order]


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    ptr = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))])
    return ptr, np.fromiter(chain.from_iterable(ids), np.int64, int(ptr[-1]))


def _gives_back(ids: list[list[int]], raw: list[bytes], table: list[bytes], size: np.ndarray) -> np.ndarray:
    """Mask of the lines whose tokens, joined, are the line."""
    ptr, flat = _flat(ids)
    run = np.concatenate([[0], np.cumsum(size[flat])])
    same = run[ptr[1:]] - run[ptr[:-1]] == np.fromiter(map(len, raw), np.int64, len(raw))
    if same.all() and b"".join([table[i] for i in flat.tolist()]) == b"".join(raw):
        return same
    return np.fromiter((b"".join([table[i] for i in x]) == r for x, r in zip(ids, raw)), bool, len(raw))


class Chunks:
    """Alignment of distinct lines: per line its number of tokens, groups and links, and the id
    pairs of its links (``link_ptr``, ``pair``: A id * 2^32 + B id); ``good`` where both sides
    give back the line."""

    def __init__(self, lines: list[str], tok: Tokenizers):
        ids_a, ids_b = tok.encode(lines)
        raw = [x.encode("utf-8", "surrogatepass") for x in lines]
        self.good = (_gives_back(ids_a, raw, tok.bytes_a, tok.size_a) & _gives_back(ids_b, raw, tok.bytes_b, tok.size_b))
        for k in np.flatnonzero(~self.good):
            ids_a[k], ids_b[k], raw[k] = [], [], b""
        n = len(lines)
        self.a_ptr, a = _flat(ids_a)
        self.b_ptr, b = _flat(ids_b)
        end_a, end_b = np.cumsum(tok.size_a[a]), np.cumsum(tok.size_b[b])
        total = int(end_a[-1]) if len(a) else 0

        # token-byte incidence: row = token, its columns = the bytes that it covers
        ptr_a, ptr_b = np.concatenate([[0], end_a]), np.concatenate([[0], end_b])
        every = np.arange(total)
        ptr, col, _ = row_products(ptr_a, every, *transposed(ptr_b, every, total), max(1, len(b)))
        link_of = np.repeat(np.arange(len(a)), np.diff(ptr))
        self.pair = (a[link_of] << 32) | b[col]
        self.link_ptr = ptr[self.a_ptr]

        # groups: both sides end at their last byte
        ends = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
        one_a, one_b = np.arange(len(a) + 1), np.arange(len(b) + 1)
        ptr, _, _ = row_products(one_a, group_a, *transposed(one_b, group_b, len(ends)), max(1, len(b)))
        self.group_links = np.diff(ptr[self.a_ptr])
        line_end = np.cumsum([len(r) for r in raw]) if n else np.zeros(0, np.int64)
        group_ptr = np.concatenate([[0], np.searchsorted(ends, line_end, "right")])
        self.n_a, self.n_b = np.diff(self.a_ptr), np.diff(self.b_ptr)
        self.n_groups, self.n_links = np.diff(group_ptr), np.diff(self.link_ptr)
        cut_a = np.concatenate([[0], np.searchsorted(group_a, np.arange(len(ends)), "right")])
        cut_b = np.concatenate([[0], np.searchsorted(group_b, np.arange(len(ends)), "right")])
        text_a, text_b = [tok.name_a[i] for i in a.tolist()], [tok.name_b[i] for i in b.tolist()]
        groups = [text_a[i] + "|" + text_b[k] if j - i == 1 == m - k else f"{','.join(text_a[i:j])}|{','.join(text_b[k:m])}"
                  for i, j, k, m in zip(cut_a[:-1].tolist(), cut_a[1:].tolist(), cut_b[:-1].tolist(), cut_b[1:].tolist())]
        self.groups = [";".join(groups[i:j]) for i, j in zip(group_ptr[:-1].tolist(), group_ptr[1:].tolist())]


def chunks_of(text: str) -> list[str]:
    """The line (a blank and the text) cut before single blanks between plain characters."""
    if not _ODD.search(text):
        return [" " + x for x in text.split(" ")]
    return _BOUNDARY.split(" " + text)


class Block:
    """The documents of a block as rows of chunk numbers (``ptr``, ``col``) over ``chunks``."""

    def __init__(self, texts, tok: Tokenizers):
        number: dict[str, int] = {}
        rows = [[number.setdefault(c, len(number)) for c in chunks_of(t)] if isinstance(t, str) and t else []
                for t in texts]
        chunks = Chunks(list(number), tok)
        odd = [k for k, r in enumerate(rows) if not chunks.good[r].all()]
        if odd:         # such a text is one chunk: what counts is whether it comes back as a whole
            for k in odd:
                rows[k] = [number.setdefault(" " + texts[k], len(number))]
            chunks = Chunks(list(number), tok)
        self.chunks = chunks
        self.ptr, self.col = _flat(rows)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of a value of the chunks over each document."""
        run = np.concatenate([[0], np.cumsum(values[self.col])])
        return run[self.ptr[1:]] - run[self.ptr[:-1]]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct linked id pairs, and the documents x pairs matrix (ptr, col, number of links)."""
        keys, at = np.unique(self.chunks.pair, return_inverse=True)
        return keys, *row_products(self.ptr, self.col, self.chunks.link_ptr, at, max(1, len(keys)))

    def digests(self) -> list[bytes]:
        """SHA-256 of each document's groups; empty without tokens."""
        groups, col, ptr, n = self.chunks.groups, self.col.tolist(), self.ptr.tolist(), self.sums(self.chunks.n_a)
        return [hashlib.sha256(";".join([groups[k] for k in col[i:j]]).encode()).digest() if m else b""
                for i, j, m in zip(ptr[:-1], ptr[1:], n.tolist())]


def _pack(values: np.ndarray) -> bytes:
    """Small numbers as little-endian bytes, deflated."""
    kind = next(t for t in ("<u1", "<u2", "<u4", "<i8") if not len(values) or t == "<i8" or
                (values.min() >= 0 and values.max() <= np.iinfo(t).max))
    return kind.encode() + zlib.compress(np.ascontiguousarray(values, kind).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[3:]), data[:3].decode()).astype(np.int64)


def _block_row(block_id: int, ids: list[int], texts: list, tok: Tokenizers) -> dict:
    block = Block(texts, tok)
    c = block.chunks
    keys, ptr, col, value = block.pairs()
    numbers = np.stack([block.sums(v) for v in (c.n_a, c.n_b, c.n_groups, c.n_links, c.group_links)])
    digests = block.digests()
    return {"block": block_id, "doc_id": _pack(np.array(ids, np.int64)), "numbers": _pack(numbers.ravel()),
            "digests": b"".join(d or bytes(32) for d in digests), "keys": _pack(keys),
            "docs": _pack(np.bincount(col, minlength=len(keys))), "ptr": _pack(np.diff(ptr)), "col": _pack(col),
            "value": _pack(value)}


def _blocks(path_a: str, path_b: str, block_bytes: int):
    def run(batches):
        tok = tokenizers(path_a, path_b)
        number = (TaskContext.get().partitionId() << 32) - 1
        ids, texts, held = [], [], 0
        for pdf in batches:
            for key, text in zip(pdf["doc_id"].tolist(), pdf["text"]):
                ids.append(key)
                texts.append(text)
                held += len(text) if isinstance(text, str) else 0
                if held >= block_bytes or len(ids) >= 50_000:
                    number += 1
                    yield pd.DataFrame([_block_row(number, ids, texts, tok)])
                    ids, texts, held = [], [], 0
        if ids:
            yield pd.DataFrame([_block_row(number + 1, ids, texts, tok)])
    return run


def _block_pairs(batches):
    for pdf in batches:
        for block, keys, docs in zip(pdf["block"], pdf["keys"], pdf["docs"]):
            keys = _unpack(keys)
            yield pd.DataFrame({"block": np.full(len(keys), block), "a": keys >> 32, "b": keys & 0xFFFFFFFF,
                                "docs": _unpack(docs)})


def _pack_back(pdf: pd.DataFrame) -> pd.DataFrame:
    """The counts of a block's pairs, in the order of its keys."""
    pdf = pdf.sort_values(["a", "b"])
    return pd.DataFrame({"block": pdf["block"].iloc[:1], "n": [_pack(pdf["n"].to_numpy(np.int64))],
                         "best": [_pack(pdf["best"].to_numpy(np.int64))]})


def _results(batches):
    for pdf in batches:
        for r in pdf.itertuples():
            ids = _unpack(r.doc_id)
            numbers = _unpack(r.numbers).reshape(len(NUMBERS), len(ids))
            out = {"doc_id": ids} | dict(zip(NUMBERS, numbers))
            col, value, size = _unpack(r.col), _unpack(r.value), _unpack(r.ptr)
            end = np.cumsum(size)
            # a block without any pair has no counts
            for name, per_pair in (("n_best", r.best), ("count_sum", r.n)):
                run = np.concatenate([[0], np.cumsum(_unpack(per_pair)[col] * value)]) if per_pair is not None else np.zeros(1, np.int64)
                out[name] = run[end] - run[end - size]
            out["groups_sha256"] = [r.digests[32 * k:32 * k + 32].hex() if n else "" for k, n in enumerate(out["n_a"].tolist())]
            yield pd.DataFrame(out)


def align_documents(docs: DataFrame, path_a: str, path_b: str, block_bytes: int = 4 << 20) -> DataFrame:
    """Per document the tokens of both sides, groups, links by overlap (``n_links``) and by group
    (``n_group_links``), the links whose id pair is held by the most documents of its A id's pairs
    (``n_best``), the sum of these numbers over the links, and the digest of its groups."""
    scanned = docs.select(filled_id(), "text")
    blocks = cut_lineage(scanned.mapInPandas(_blocks(path_a, path_b, block_bytes), BLOCK))
    pairs = blocks.select("block", "keys", "docs").mapInPandas(_block_pairs, PAIRS)
    total = pairs.groupBy("a", "b").agg(F.sum("docs").alias("n"))
    most = total.groupBy("a").agg(F.max("n").alias("most"))
    counted = total.join(most, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))
    back = pairs.select("block", "a", "b").join(counted, ["a", "b"]).groupBy("block").applyInPandas(_pack_back, BACK)
    joined = blocks.drop("keys", "docs").join(back, "block", "left")
    return with_null_ids(joined.mapInPandas(_results, RESULT))
