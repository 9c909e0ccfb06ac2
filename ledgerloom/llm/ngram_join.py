"""N-gram Jaccard join by parity sketches.

A text's set holds its distinct word shingles.  Each shingle flips bits of a sketch, so the
Hamming distance of two sketches lower-bounds the symmetric difference of the sets.  Linked sets
(100 * intersection >= percent * union) differ in at most d elements, where d follows from
their sizes; a sketch of d + 1 + r parts therefore has r + 1 equal parts for every linked pair.

1. Sizes fall into bands whose width is the threshold, so linked sets lie in one band or in
   neighbouring ones.  Per pair of bands a set has one sketch; its keys are (bands, part, the
   64 parity bits of the part, in which an element flips the bits of its hash).  An empty part
   would join sets that share nothing.  A set with at most r empty parts leaves them out: one of
   the r + 1 equal parts holds something.  Only a set with more of them keeps them as keys, and
   whatever it is equal to in empty parts alone has as many.  r follows from the band.
2. Blocks exchange distinct keys (``recurring``).  A linked set misses at most d of the keys, so
   only sets of which all but d recur go on.  Of keys with the same members (128 bits of them)
   one is kept.
3. Star: within a key the smallest set is compared with the others.  A longer sketch of the
   whole set rejects pairs whose Hamming distance is too large, the rest is verified exactly.
   Verified links give components.
4. Rest: where a key still joins different components, members of different components are
   compared, in slices of at most ``slice_rows`` so that a frequent key is spread over tasks;
   sketches reject, survivors are verified.  The first time a key only gives pairs that join
   components not yet joined there, so a group of near-copies never lists its pairs; the second
   time all that still lie in different components.  No link between components is lost.

Equal sets are one element from the start (only their class is carried on).  A set is named by
a 64-bit hash of its elements; shingles are compared by 64-bit hashes.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text with fewer words than a shingle
has its whole sequence as one element.  A text without words (or null) has the empty set and is
linked with nothing.  Rows with a null doc_id take part, but name a component only as null when
no other row is in it; repeated rows are copies; an empty table gives no rows.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import star_components
from ..session import cut_lineage
from .phrases import blocks_of
from .recurring import SENT, member, received, recurring, send
from .textblocks import (U64, Words, as_bytes, free_shuffles, mix64, passing_shuffles, slices, with_null_ids,
                         word_windows, words_of)


def shingle_sets(w: Words, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, _ = word_windows(w, size)
    out = []
    for t in range(len(w.first) - 1):
        a, b = int(w.first[t]), int(w.first[t + 1])
        if b - a >= size:
            out.append(np.unique(h[a:b - size + 1]))
        elif b > a:
            x = mix64(np.array([b - a], U64))
            for v in w.hash[a:b]:
                x = mix64(x * U64(0xD6E8FEB86659FD93) + v)
            out.append(x)
        else:
            out.append(np.zeros(0, U64))
    return out


def name_of(s: np.ndarray) -> int:
    """64-bit name of a set, as a signed integer."""
    x = np.bitwise_xor.reduce(mix64(s + U64(0x9E3779B97F4A7C15))) + U64(len(s)) * U64(0xA0761D6478BD642F)
    return int(mix64(np.array([x + s.sum(dtype=U64)], U64)).astype(np.int64)[0])


def block_sets(pdf: pd.DataFrame, size: int) -> list[np.ndarray]:
    """Shingle sets of a block's texts, A-Z lower-cased."""
    texts = as_bytes(pdf["text"])
    return [s for lo, hi in slices(texts) for s in shingle_sets(words_of(texts[lo:hi], lower=True), size)]


class Bands:
    """Size bands, and how far linked sets of a pair of bands can differ."""

    def __init__(self, percent: int):
        self.percent = percent
        self.ratio = math.log(100 / percent)

    def band(self, n: int) -> int:
        return int(math.log(n) / self.ratio + 1e-9)

    def top(self, band: int) -> int:
        n = int(math.exp((band + 1) * self.ratio)) + 2
        while self.band(n) > band:
            n -= 1
        return n

    def differing(self, total):
        """Largest symmetric difference of linked sets with ``total`` elements together."""
        return total * (100 - self.percent) // (100 + self.percent)

    def limit(self, band: int) -> int:
        """The same for the sets of a band with each other and with the next band."""
        a = self.top(band)
        return self.differing(a + a * 100 // self.percent)


def sketch(s: np.ndarray, parts: int) -> np.ndarray:
    """Parity sketch of ``parts`` words of 64 bits: each element flips one bit of one part."""
    part = ((s >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)
    out = np.zeros(parts, U64)
    if len(s):
        order = np.argsort(part, kind="stable")
        part = part[order]
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        out[part[first]] = np.bitwise_xor.reduceat((U64(1) << (s & U64(63)))[order], first)
    return out


def spare_parts(size: int, d: int) -> int:
    """r: more than the empty parts that a set of this size has in d + 1 parts, as a rule."""
    empty = (d + 1) * math.exp(-size / (d + 1))
    return 1 + math.ceil(empty + 4 * math.sqrt(empty))


def part_words(s: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(64 parity bits, number of elements) of each part; an element flips the bits of its hash."""
    part = ((s >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    held = np.bincount(part, minlength=parts)
    out = np.zeros(parts, U64)
    some = np.flatnonzero(held)
    if len(some):
        out[some] = np.bitwise_xor.reduceat(mix64(s ^ U64(0x2545F4914F6CDD1D))[order], (np.cumsum(held) - held)[some])
    return out, held


def band_keys(s: np.ndarray, bands: Bands) -> list[tuple[int, np.ndarray, int]]:
    """(pair of bands, keys, words of the rejecting sketch) of a set; none where only equal sets link."""
    out = []
    if len(s):
        b = bands.band(len(s))
        for g in (b, b - 1):
            d = bands.limit(g) if g >= 0 else 0
            if d:
                spare = spare_parts(bands.top(g), d)
                words, held = part_words(s, d + 1 + spare)
                salt = np.arange(len(words)).astype(U64) * U64(0x9E3779B97F4A7C15) + U64(g + 1)
                keys = mix64(words ^ mix64(salt))
                if (held == 0).sum() <= spare:
                    keys = keys[held > 0]
                out.append((g, keys, d // 8 + 2))
    return out


def _send_keys(size: int, percent: int, shards: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bands = Bands(percent)
        seen: set[int] = set()
        keys = []
        for s in block_sets(pdf, size):
            name = name_of(s)
            if name not in seen:
                seen.add(name)
                keys += [k for _, k, _ in band_keys(s, bands)]
        keys = np.concatenate(keys) if keys else np.zeros(0, U64)
        return send(int(pdf["block"].iloc[0]), keys[:, None], shards)
    return run


#: kind 0: a document (doc_id, n, name); 1: keys and rejecting sketch of a set in a pair of
#: bands; 2: the elements of a set
FOUND = "kind int, doc_id long, name long, n long, band int, keys binary, data binary"


def _find(size: int, percent: int):
    def run(pdf: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({c.split()[0]: [] for c in FOUND.split(", ")})
        bands, have, rows, seen = Bands(percent), received(back, 1), [], set()
        sets = block_sets(pdf, size)
        for key, s in zip(pdf["doc_id"], sets):
            name = name_of(s)
            rows.append((0, int(key), name, len(s), 0, None, None))
            if name in seen:
                continue
            seen.add(name)
            some = False
            for g, keys, words in band_keys(s, bands):
                least = len(keys) - bands.limit(g)       # of its parts a linked set changes d at most
                keys = keys[member(keys[:, None], have)]
                if len(keys) >= least:
                    some = True
                    rows.append((1, 0, name, len(s), g, keys.astype("<u8").tobytes(), sketch(mix64(s), words).tobytes()))
            if some:
                rows.append((2, 0, name, len(s), 0, None, s.tobytes()))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")])
    return run


def _unpack(batches):
    for pdf in batches:
        keys = [np.frombuffer(k, "<i8") for k in pdf["keys"]]
        size = [len(k) for k in keys]
        yield pd.DataFrame({"key": np.concatenate(keys) if keys else np.zeros(0, np.int64),
                            "name": np.repeat(pdf["name"].to_numpy(), size), "n": np.repeat(pdf["n"].to_numpy(), size),
                            "band": np.repeat(pdf["band"].to_numpy(), size)})


def _near(a: np.ndarray, b: np.ndarray, na, nb, bands: Bands) -> np.ndarray:
    """Mask: sizes and Hamming distance allow a link."""
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    return (100 * small >= bands.percent * large) \
        & (np.bitwise_count(a ^ b).sum(-1, dtype=np.int64) <= bands.differing(na + nb))


def _reject(percent: int):
    """Rows of two sets with their sketches -> rows that may be linked."""
    def run(batches):
        bands = Bands(percent)
        for pdf in batches:
            keep = [len(x) == len(y) and bool(_near(np.frombuffer(x, U64), np.frombuffer(y, U64), n, m, bands))
                    for x, y, n, m in zip(pdf["sa"], pdf["sb"], pdf["na"], pdf["nb"])]
            yield pdf.loc[keep, ["a", "b"]]
    return run


def _verify(percent: int):
    def run(batches):
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["da"], pdf["db"]):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pdf.loc[keep, ["a", "b"]]
    return run


def _across(percent: int, spanning: bool):
    """Members of (key, slice pair) groups -> pairs of different components that may be linked:
    all of them, or only such as join a component to one not yet joined in the group."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bands, out = Bands(percent), []
        for (_, lo, hi), g in pdf.groupby(["key", "lo", "hi"]):
            g = g.sort_values("name")
            name, n, root = (g[c].to_numpy(np.int64) for c in ("name", "n", "root"))
            label = np.unique(root, return_inverse=True)[1]
            side = g["slice"].to_numpy() != lo if lo != hi else np.ones(len(g), bool)
            bits = np.stack([np.frombuffer(s, U64) for s in g["sketch"]])
            left = np.flatnonzero(~side) if lo != hi else np.arange(len(g))
            right = np.flatnonzero(side)
            step = max(1, (1 << 21) // max(1, len(right) * bits.shape[1]))
            for i in range(0, len(left), step):
                a = left[i:i + step]
                ok = label[a][:, None] != label[right][None, :]
                if not ok.any():
                    continue
                ok &= _near(bits[a][:, None, :], bits[right][None, :, :], n[a][:, None], n[right][None, :], bands)
                if not spanning:
                    x, y = np.nonzero(ok)
                    out.append(np.stack([name[a[x]], name[right[y]]], 1))
                    continue
                for j in np.flatnonzero(ok.any(1)):
                    mates = right[ok[j]]
                    other, first = np.unique(label[mates], return_index=True)
                    new = other != label[a[j]]
                    if new.any():
                        mates = mates[first[new]]
                        out.append(np.stack([np.full(len(mates), name[a[j]]), name[mates]], 1))
                        label[np.isin(label, other[new])] = label[a[j]]
        pairs = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        pairs = np.unique(np.sort(pairs, 1), axis=0)
        return pd.DataFrame(pairs, columns=["a", "b"])
    return run


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a = sets.select(F.col("name").alias("a"), F.col("data").alias("da"))
    b = sets.select(F.col("name").alias("b"), F.col("data").alias("db"))
    return pairs.join(a, "a").join(b, "b").mapInPandas(_verify(percent), "a long, b long")


def _mixed(held: DataFrame, roots: DataFrame, sketches: DataFrame, slice_rows: int, buckets: int) -> DataFrame:
    """Members of the keys that join several components, in pairs of slices, with sketches."""
    m = held.join(roots.withColumnRenamed("node", "name"), "name", "left").withColumn("root", F.coalesce("root", "name"))
    mixed = m.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("key")
    slices = F.ceil(F.col("members") / slice_rows).cast("int")
    m = (m.join(mixed, "key").withColumn("slice", F.pmod(F.xxhash64("name"), slices).cast("int"))
         .withColumn("other", F.explode(F.sequence(F.lit(0), slices - 1)))
         .select("key", "name", "n", "band", "root", "slice", F.least("slice", "other").alias("lo"),
                 F.greatest("slice", "other").alias("hi")))
    return m.join(sketches.drop("n"), ["name", "band"]).withColumn(
        "bucket", F.pmod(F.xxhash64("key", "lo", "hi"), F.lit(buckets)))


def _kept(df: DataFrame) -> DataFrame:
    """A reliable checkpoint that leaves no shuffle files of its plan, or of the rounds before it, on the
    disks beside those of the next steps.  Those of a round are small, but at least one per task.
    What stands before it must not run again, since its exchanges are gone."""
    spark = df.sparkSession
    with passing_shuffles(spark):
        out = cut_lineage(df.select("*"))
    del df
    free_shuffles(spark)
    return out


def components(pairs: DataFrame) -> DataFrame:
    return star_components(pairs, _kept)


def link_documents(docs: DataFrame, size: int = 3, percent: int = 90, block_bytes: int = 6 << 20,
                   slice_rows: int = 4096) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) of every row."""
    d, blocks = blocks_of(docs, block_bytes)
    by_block = d.groupBy("block")
    keys = recurring(by_block.applyInPandas(_send_keys(size, percent, blocks), SENT), 1)
    found = _kept(by_block.cogroup(keys.groupBy("block")).applyInPandas(_find(size, percent), FOUND))
    del d, by_block, keys
    rows = found.where("kind = 0").select("doc_id", "name", "n")
    entry = found.where("kind = 1").select("name", "n", "band", F.col("data").alias("sketch"))
    sketches = entry.groupBy("name", "band").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    sets = found.where("kind = 2").groupBy("name").agg(F.first("data").alias("data"))
    held = found.where("kind = 1").select("keys", "name", "n", "band").mapInPandas(
        _unpack, "key long, name long, n long, band int").distinct()
    # near-copies share most of their keys: of the keys with the same members one is enough
    mark = lambda seed: F.bit_xor(F.xxhash64("name", F.lit(seed)))
    groups = held.groupBy("key").agg(F.min("name").alias("lead"), F.max("name").alias("last"), F.min("band").alias("band"),
                                     F.count(F.lit(1)).alias("members"), mark(1).alias("x"), mark(2).alias("y"))
    one = groups.where("lead < last").groupBy("lead", "last", "band", "members", "x", "y").agg(F.min("key").alias("key"))
    held = _kept(held.join(one.select("key", "lead", "members"), "key"))

    star = held.where("name <> lead").select(F.col("lead").alias("a"), F.col("name").alias("b"), "band").distinct()
    one = sketches.select(F.col("name").alias("a"), "band", F.col("n").alias("na"), F.col("sketch").alias("sa"))
    two = sketches.select(F.col("name").alias("b"), "band", F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    near = star.join(one, ["a", "band"]).join(two, ["b", "band"]).select("a", "b", "na", "nb", "sa", "sb")
    links = _kept(_links(near.mapInPandas(_reject(percent), "a long, b long").distinct(), sets, percent))

    # what may join components: a spanning choice first, then all that is left
    for spanning in (True, False):
        members = _mixed(held, components(links), sketches, slice_rows, 16 * blocks)
        across = members.groupBy("bucket").applyInPandas(_across(percent, spanning), "a long, b long").distinct()
        links = _kept(links.unionByName(_links(across, sets, percent)))
    roots = _kept(components(links).withColumnRenamed("node", "name"))

    # classes of equal sets -> components -> smallest document
    firsts = rows.where("n > 0").groupBy("name").agg(F.min("doc_id").alias("first")).join(roots, "name", "left")
    firsts = firsts.withColumn("root", F.coalesce("root", "name"))
    smallest = firsts.groupBy("root").agg(F.min("first").alias("component_id"))
    named = firsts.join(smallest, "root").select("name", "component_id")
    linked = rows.where("n > 0").join(named, "name")
    alone = rows.where("n = 0").withColumn("component_id", F.col("doc_id"))
    cols = ["doc_id", F.col("n").alias("n_shingles"), "component_id"]
    return with_null_ids(linked.select(*cols).unionByName(alone.select(*cols)), "doc_id", "component_id")
