"""Which keys of the blocks recur anywhere: one exchange to key shards and one back to blocks.

A block sends every distinct 128- or 64-bit key once, with a mark if it has it more than once,
packed into one binary value per shard.  However frequent a key is, a shard gets it at most
once per block.  The shard (a range of hash values, bounded in size) returns to each block the
keys of that block which occur at least twice in all.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .textblocks import U64

SENT = "shard long, block long, once binary, more binary"
BACK = "block long, keys binary"


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Shard number from the upper 32 bits of a mixed hash: ranges of equal width."""
    return ((h >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)


def send(block: int, keys: np.ndarray, shards: int) -> pd.DataFrame:
    """keys: (n, width) uint64, the first column decides the shard."""
    if not len(keys):
        return pd.DataFrame({"shard": [], "block": [], "once": [], "more": []})
    keys = keys[np.lexsort(keys.T[::-1])]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate([first, [len(keys)]]))
    keys = keys[first]
    shard = shard_of(keys[:, 0], shards)
    cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
    rows = []
    for a, b in zip(cut[:-1], cut[1:]):
        part, many = keys[a:b], count[a:b] > 1
        rows.append((int(shard[a]), block, part[~many].tobytes(), part[many].tobytes()))
    return pd.DataFrame(rows, columns=["shard", "block", "once", "more"])


def _recurring(width: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts, blocks, weight = [], [], []
        for block, once, more in zip(pdf["block"], pdf["once"], pdf["more"]):
            for w, data in ((1, once), (2, more)):
                if len(data):
                    parts.append(np.frombuffer(data, U64).reshape(-1, width))
                    blocks.append(np.full(len(parts[-1]), block, np.int64))
                    weight.append(np.full(len(parts[-1]), w, np.int8))
        if not parts:
            return pd.DataFrame({"block": [], "keys": []})
        keys, block, weight = np.concatenate(parts), np.concatenate(blocks), np.concatenate(weight)
        del parts, blocks
        order = np.lexsort(keys.T[::-1])
        keys, block, weight = keys[order], block[order], weight[order]
        new = np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])
        group = np.cumsum(new) - 1
        keep = np.bincount(group, weight)[group] > 1
        keys, block = keys[keep], block[keep]
        order = np.argsort(block, kind="stable")      # keys stay sorted inside a block
        keys, block = keys[order], block[order]
        cut = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])) if len(block) else []
        return pd.DataFrame([(int(block[a]), keys[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:])],
                            columns=["block", "keys"])
    return run


def recurring(sent: DataFrame, width: int) -> DataFrame:
    return sent.groupBy("shard").applyInPandas(_recurring(width), BACK)


def received(pdf: pd.DataFrame, width: int) -> np.ndarray:
    """Keys that came back to one block, in order of their first column."""
    data = b"".join(pdf["keys"]) if len(pdf) else b""
    keys = np.frombuffer(data, U64).reshape(-1, width)
    return keys[np.argsort(keys[:, 0], kind="stable")]


def member(keys: np.ndarray, have: np.ndarray) -> np.ndarray:
    """Mask of the rows of ``keys`` that are in ``have`` (sorted by its first column)."""
    if not len(have) or not len(keys):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(have[:, 0], keys[:, 0]), len(have) - 1)
    found = (have[at] == keys).all(1)
    # equal first columns with different rests are very rare: look further along those only
    open_ = np.flatnonzero(~found & (have[at, 0] == keys[:, 0])) if keys.shape[1] > 1 else []
    for i in open_:
        j = at[i]
        while j < len(have) and have[j, 0] == keys[i, 0] and not found[i]:
            found[i] = (have[j] == keys[i]).all()
            j += 1
    return found
