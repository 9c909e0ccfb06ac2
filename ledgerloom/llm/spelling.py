"""Spelling variants: near words by k-d trees over letter counts.

Words that differ by one inserted, deleted or replaced letter have letter-count vectors at L1
distance 1 (lengths l and l + 1) or 2 (equal lengths, 0 never for a single replacement).  Range
searches of that radius run per pair of lengths:

1. Upper trees.  For each length a k-d tree over the vectors of a sample of the words (a bounded
   number, ``SAMPLE``, drawn by hash; it decides where words are searched, not which) cuts the
   words into *cells*.  A word goes to its own cell as a point, and as a query to every cell
   whose box lies within the radius, for its own length and the next.
2. Cells.  A task builds the k-d tree of a cell's points and sends all its queries down together,
   dropping a query from a branch when its box is too far (the distance is kept up incrementally,
   one dimension a level).  At the leaves the parities of the counts are compared as bit sets (they
   differ in at most as many letters as the counts), then the vectors, then the order of the letters.
3. Each task gives back one row per word: how many near words and the best of them.  Spark adds
   them up, chooses the form, and follows forms to the root by doubling: as n at least doubles
   from a word to its form, chains are short and have no cycle.

Words are any strings; letters are code points up to U+00FF, others share one dimension (the
distance stays a lower bound).  Equal words are one word with its largest n; null words are no
words; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

LEAF = 96                   # points of a leaf
CELL = 4_096                # words of a cell, as far as MAX_CELLS allows
MAX_CELLS = 8_192
SAMPLE = 32                 # sampled words per cell
DEALT = "cell long, point boolean, word string, n long"
FOUND = "word string, n_near long, best_n long, best string"
OTHER = 256


def marked_words(docs: DataFrame, modulus: int = 97, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """word, n: runs of Latin letters of all texts, A-Z lower-cased, with their number.

    Where ``modulus`` divides h = crc32(doc_id:run), the run loses its letter number h % length (so
    there are misspellings to find).  Null texts have no words; a null doc_id is written ''."""
    run = F.explode(F.split("text", r"[^A-Za-z\x{C0}-\x{FF}]+")).alias("run")
    lower = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), run)
    runs = runs.where(F.char_length("run") >= least_length).select("doc_id", lower.alias("run"))
    h = F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary"))
    runs = runs.select("run", h.alias("h"))
    at = F.pmod("h", F.char_length("run").cast("long")).cast("int")
    cut = F.concat(F.left("run", at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    word = F.when(F.col("h") % modulus == 0, cut).otherwise(F.col("run"))
    return (runs.select(word.alias("word")).where(F.char_length("word") >= least_length)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count))


def codes_of(words: list[str], length: int) -> np.ndarray:
    """(words, length) code points."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)


def count_vectors(codes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Counts of the given letters (the last: all others) in each word."""
    at = np.searchsorted(letters, np.minimum(codes, OTHER)) + np.arange(len(codes))[:, None] * len(letters)
    return np.bincount(at.ravel(), minlength=len(codes) * len(letters)).astype(np.int16).reshape(len(codes), len(letters))


def parities(codes: np.ndarray) -> np.ndarray:
    """One 64-bit set per word: the letters (modulo 64) that it has an odd number of."""
    return np.bitwise_xor.reduce(np.uint64(1) << (codes & 63).astype(np.uint64), axis=1) if codes.shape[1] \
        else np.zeros(len(codes), np.uint64)


LETTERS = np.arange(OTHER + 1)


class KdTree:
    """Splits at the median of the widest dimension down to ``leaf`` points; ``leaves`` are arrays
    of point numbers."""

    def __init__(self, vectors: np.ndarray, leaf: int):
        self.nodes: list[tuple] = []        # (dimension, value, left, right) or (leaf number,)
        self.leaves: list[np.ndarray] = []
        self._build(vectors, np.arange(len(vectors)), leaf)

    def _build(self, v: np.ndarray, points: np.ndarray, leaf: int) -> int:
        me = len(self.nodes)
        self.nodes.append(())
        if len(points) > leaf:
            part = v[points]
            for dim in np.argsort(-part.var(0), kind="stable")[:1]:
                x = part[:, dim]
                cut = int(np.sort(x)[(len(x) - 1) // 2])
                if cut == x.max():      # the value below it, so that both sides hold points
                    cut -= 1
                if x.min() <= cut < x.max():
                    left = self._build(v, points[x <= cut], leaf)
                    right = self._build(v, points[x > cut], leaf)
                    self.nodes[me] = (int(dim), cut, left, right)
                    return me
        self.nodes[me] = (len(self.leaves),)
        self.leaves.append(points)
        return me

    def reach(self, queries: np.ndarray, radius: int):
        """(leaf, numbers of the queries whose ball of L1 ``radius`` meets the leaf's box)."""
        low, high = np.full(queries.shape[1], -(1 << 14)), np.full(queries.shape[1], 1 << 14)
        stack = [(0, np.arange(len(queries)), np.zeros(len(queries), np.int32), low, high)]
        while stack:
            node, q, far, low, high = stack.pop()
            if len(self.nodes[node]) == 1:
                yield self.nodes[node][0], q
                continue
            dim, cut, left, right = self.nodes[node]
            x = queries[q, dim].astype(np.int32)
            rest = far - np.maximum(0, np.maximum(low[dim] - x, x - high[dim]))
            for child, lo, hi in ((left, low[dim], cut), (right, cut + 1, high[dim])):
                now = rest + np.maximum(0, np.maximum(lo - x, x - hi))
                near = now <= radius
                if near.any():
                    a, b = low.copy(), high.copy()
                    a[dim], b[dim] = lo, hi
                    stack.append((child, q[near], now[near], a, b))


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mask of the rows where the words differ by one letter replaced (equal lengths), or where b
    is a with one letter more."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    same = np.cumprod(a == b[:, :-1], axis=1).sum(1) + np.cumprod((a == b[:, 1:])[:, ::-1], axis=1).sum(1)
    return same >= a.shape[1]


def near_pairs(queries: list[str], points: list[str]):
    """(number of the query, of the point) of all pairs at one edit; all queries have one length,
    all points the same or one more."""
    if not queries or not points:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = codes_of(queries, len(queries[0])), codes_of(points, len(points[0]))
    radius = 2 if a.shape[1] == b.shape[1] else 1
    letters = np.unique(np.concatenate([np.minimum(a, OTHER).ravel(), np.minimum(b, OTHER).ravel()]))
    va, vb = count_vectors(a, letters), count_vectors(b, letters)
    pa, pb = parities(a), parities(b)
    tree = KdTree(vb, LEAF)
    left, right = [], []
    for leaf, q in tree.reach(va, radius):
        mine = tree.leaves[leaf]
        for s in range(0, len(q), 2048):
            part = q[s:s + 2048]
            for t in range(0, len(mine), LEAF):     # a leaf of equal vectors can be long
                some = mine[t:t + LEAF]
                i, j = np.nonzero(np.bitwise_count(pa[part][:, None] ^ pb[some][None, :]) <= radius)
                i, j = part[i], some[j]
                ok = np.abs(va[i] - vb[j]).sum(1) <= radius
                i, j = i[ok], j[ok]
                ok = one_edit(a[i], b[j])
                left.append(i[ok])
                right.append(j[ok])
    return np.concatenate(left), np.concatenate(right)


class Cells:
    """Cells of the upper trees: one tree per sampled length; another length is one cell."""

    def __init__(self, sample: list[str], cell_sample: int):
        self.trees: dict[int, tuple[int, KdTree]] = {}
        by_length: dict[int, list[str]] = {}
        for w in sorted(sample):
            by_length.setdefault(len(w), []).append(w)
        self.size = 0
        for length, words in sorted(by_length.items()):
            tree = KdTree(count_vectors(codes_of(words, length), LETTERS), cell_sample)
            self.trees[length] = (self.size, tree)
            self.size += len(tree.leaves)

    def reach(self, vectors: np.ndarray, length: int, radius: int):
        """(cell, numbers of the words near its box) among the words of ``length``."""
        if length not in self.trees:
            yield self.size + length, np.arange(len(vectors))
            return
        base, tree = self.trees[length]
        for leaf, q in tree.reach(vectors, radius):
            yield base + leaf, q


def _deal(cells: Cells):
    def rows(cell, point, words, n, q):
        return pd.DataFrame({"cell": np.full(len(q), cell, np.int64), "point": np.full(len(q), point),
                             "word": words[q], "n": n[q]})

    def run(batches):
        for pdf in batches:
            for length, part in pdf.groupby(pdf["word"].str.len()):
                words, n = part["word"].to_numpy(object), part["n"].to_numpy(np.int64)
                v = count_vectors(codes_of(list(words), int(length)), LETTERS)
                out = [rows(c, True, words, n, q) for c, q in cells.reach(v, int(length), 0)]
                for other, radius in ((int(length), 2), (int(length) + 1, 1)):
                    out += [rows(c, False, words, n, q) for c, q in cells.reach(v, other, radius)]
                yield pd.concat(out)
    return run


def _search(pdf: pd.DataFrame) -> pd.DataFrame:
    word, n = pdf["word"].to_numpy(object), pdf["n"].to_numpy(np.int64)
    points = np.flatnonzero(pdf["point"].to_numpy())
    size = pdf["word"].str.len().to_numpy()
    pairs = []
    for length in np.unique(size[points]):
        some = points[size[points] == length]
        for other in (length, length - 1):
            queries = np.flatnonzero(~pdf["point"].to_numpy() & (size == other))
            i, j = near_pairs(list(word[queries]), list(word[some]))
            i, j = queries[i], some[j]
            pairs.append(np.stack([i, j], 1))
            if other != length:             # found from the shorter word only
                pairs.append(np.stack([j, i], 1))
    pairs = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
    found = pd.DataFrame({"word": word[pairs[:, 0]], "best": word[pairs[:, 1]], "best_n": n[pairs[:, 1]]})
    found = found.sort_values(["best_n", "best"], ascending=[False, True], kind="stable")
    out = found.groupby("word", sort=False).agg(n_near=("best", "size"), best_n=("best_n", "first"), best=("best", "first"))
    return out.reset_index()[["word", "n_near", "best_n", "best"]]


def near_words(words: DataFrame, cell_words: int = CELL) -> DataFrame:
    """word, n_near, best_n, best (the near word of largest n, then the smallest) of every word that
    has a near word.  ``words``: distinct (word, n), a table that is read several times."""
    total = words.count()
    count = min(MAX_CELLS, -(-total // cell_words))
    drawn = words.where(F.pmod(F.xxhash64("word"), F.lit(max(1, total // max(1, count * SAMPLE)))) == 0)
    cells = Cells([r[0] for r in drawn.select("word").limit(4 * MAX_CELLS * SAMPLE).collect()], SAMPLE)
    found = words.mapInPandas(_deal(cells), DEALT).groupBy("cell").applyInPandas(_search, FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), "best")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("best.minus")).alias("best_n"), F.col("best.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last word when forms (word, form) are followed, by pointer doubling."""
    at = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = cut_lineage(at.join(step, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if at.where("moved").isEmpty():
            return at.drop("moved")
        at = at.drop("moved")


def variants(words: DataFrame, factor: int = 2, cell_words: int = CELL) -> DataFrame:
    """word, n, n_near, form, form_n, root: a word's form is its near word of largest n, if that is at
    least ``factor`` times its own; the root is where forms end (the word itself without one)."""
    words = cut_lineage(words.where("word is not null").groupBy("word").agg(F.max("n").cast("long").alias("n")))
    near = near_words(words, cell_words)
    fits = F.col("best_n") >= factor * F.col("n")
    judged = cut_lineage(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n")))
    ends = roots(judged.where("form is not null"))
    return judged.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
