"""Nearest neighbours by a hash-prefix forest.

Every distinct vector gets one long hash string per tree: a row of cross-polytope symbols (the
largest coordinate, with its sign, after a random rotation).  A tree is the array of its strings
in sorted order; Spark keeps it as range partitions of (tree, string), so a frequent prefix is
cut by size like everything else.  A query descends to its longest matching prefix, the run of
entries around its own place; from there all trees go up in step, one symbol at a time, and the
runs of all trees are the candidates as soon as they hold ``candidates`` entries.  Candidates
are scored by inner product in double precision inside the partition, with the original vectors.

A tree can only look at its own partition; there are ``trees`` views of the data, cut at
different places.  Entries of one string that would fill more than a partition (a group of
near-copies) are ordered by a second string, hashed from their direction off the centre of their
run, again up to ``ROUNDS`` times while a run stays too long; what is equal even then lies in an
order that is random per tree.  Queries lie among the entries by the same order, so each tree
shows them the part of their run that is nearest by its hashes.  Per level a tree keeps its best k+1 entries and its counts, which is all that
the joint ascent needs, whatever the level it stops at.

Equal vectors are one entry with their smallest k+1 ids, so a very common vector costs no more
than a rare one and ties go to the smaller ids.  Where norms differ, vectors get the usual extra
coordinate that turns the largest inner product into the smallest angle.

Vectors null, zero, or with null or non-finite components take no part, neither do those of
another length than ``dims`` (by default that of the first vector by id).  A null id takes no
part.  Fewer candidates than k give fewer rows; an empty table gives none.  Repeated (id,
vector) rows count once; of an id with several vectors, each is a candidate and a query.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TREES, SYMBOLS, CANDIDATES = 48, 4, 4000
ROUNDS = 3


def usable(vectors: DataFrame, id_col: str, vec_col: str, dims: int | None) -> tuple[DataFrame, int]:
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = v.where("id is not null and size(v) > 0").where(F.forall("v", fine) & F.exists("v", lambda x: x != 0))
    if dims is None:
        first = v.agg(F.min_by(F.size("v"), "id").alias("d")).first()["d"]
        dims = int(first or 0)
    return v.where(F.size("v") == dims).withColumn("v", F.transform("v", lambda x: x + 0.0)), dims


def _rotations(dims: int, trees: int, symbols: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.stack([np.linalg.qr(rng.standard_normal((dims, dims)))[0] for _ in range(trees * symbols)]).astype(np.float32)


def codes(x: np.ndarray, rotations: np.ndarray, tree: int, symbols: int) -> np.ndarray:
    """Hash strings of the rows of x in one tree, as integers."""
    bits = (2 * x.shape[1] - 1).bit_length()
    out = np.zeros(len(x), np.int64)
    rows = np.arange(len(x))
    for s in range(symbols):
        y = x @ rotations[tree * symbols + s]
        top = np.abs(y).argmax(1)
        out = (out << bits) | (2 * top + (y[rows, top] > 0))
    return out


def _deeper(x: np.ndarray, code: np.ndarray, rotations: np.ndarray, tree: int, symbols: int, centres: dict) -> list[tuple]:
    """Per row the strings of its direction from the centres of its run, where runs have one."""
    out = [()] * len(x)

    def go(rows: np.ndarray, path: tuple) -> None:
        centre = centres.get((tree, *path))
        if centre is None:
            for i in rows:
                out[i] = path[1:]
            return
        own = codes(x[rows] - centre, rotations, tree, symbols)
        for c in np.unique(own):
            go(rows[own == c], (*path, int(c)))

    if centres:
        for c in np.unique(code):
            go(np.flatnonzero(code == c), (int(c),))
    return out


class _Hash:
    """Rows of vectors -> their strings in each tree."""

    def __init__(self, dims: int, largest: float, extra: bool, trees: int, symbols: int, seed: int):
        self.dims, self.largest, self.extra = dims, largest, extra
        self.trees, self.symbols, self.seed = trees, symbols, seed

    def points(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entries, queries) of the rows, with the extra coordinate if there is one."""
        x = q = raw / self.largest
        if self.extra:
            rest = np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(1)))
            q = raw / np.sqrt((raw * raw).sum(1))[:, None]
            x, q = np.hstack([x, rest[:, None]]), np.hstack([q, np.zeros((len(raw), 1))])
        return x.astype(np.float32), q.astype(np.float32)

    def strings(self, batches, centres: dict):
        """(batch, raw vectors, points, tree, whether of queries, mask of their rows, codes, further strings)"""
        rot = _rotations(self.dims + self.extra, self.trees, self.symbols, self.seed)
        for pdf in batches:
            if not len(pdf):
                continue
            raw = np.stack(pdf["v"].to_numpy()).astype(np.float64)
            points = self.points(raw)
            for t in range(self.trees):
                for ask, mask in enumerate((np.ones(len(raw), bool), pdf["ask"].to_numpy(bool))):
                    if mask.any():
                        x = points[ask][mask]
                        code = codes(x, rot, t, self.symbols)
                        yield pdf, raw, x, t, bool(ask), mask, code, _deeper(x, code, rot, t, self.symbols, centres)

    def rows(self, centres):
        def run(batches):
            for pdf, raw, _, t, ask, mask, code, sub in self.strings(batches, centres.value):
                yield pd.DataFrame({"tree": t, "code": code, "sub": sub, "ask": ask, "rep": pdf["rep"].to_numpy()[mask],
                                    "vec": [r.tobytes() for r in raw[mask]]})
        return run

    def places(self, centres):
        """The strings of the entries alone."""
        def run(batches):
            for _, _, _, t, ask, _, code, sub in self.strings(batches, centres.value):
                if not ask:
                    yield pd.DataFrame({"tree": t, "code": code, "sub": sub})
        return run

    def sums(self, centres, hot):
        """Number and sum of a partition's entries in each of the runs ``hot``."""
        def run(batches):
            total: dict[tuple, list] = {}
            for _, _, x, t, ask, _, code, sub in self.strings(batches, centres.value):
                for i, key in enumerate(zip(code.tolist(), sub)) if not ask else ():
                    key = (t, key[0], *key[1])
                    if key in hot.value:
                        have = total.setdefault(key, [0, np.zeros(x.shape[1])])
                        have[0] += 1
                        have[1] += x[i]
            yield pd.DataFrame([(k[0], k[1], k[2:], n, v.tobytes()) for k, (n, v) in total.items()],
                               columns=["tree", "code", "sub", "n", "total"])
        return run


def _centre(key, pdf):
    total = np.sum([np.frombuffer(v, np.float64) for v in pdf["total"]], axis=0) / pdf["n"].sum()
    return pd.DataFrame([(key[0], key[1], key[2], total.astype(np.float32).tobytes())], columns=["tree", "code", "sub", "centre"])


def _centres(groups: DataFrame, hashing: _Hash, part_rows: int) -> dict:
    """(tree, string, further strings..) -> centre, of the runs longer than a partition; runs are
    counted, and centres taken, on one of ``every`` vectors by hash."""
    sc = groups.sparkSession.sparkContext
    every = max(1, part_rows // 2048)
    sample = groups.where(F.pmod(F.xxhash64("v"), F.lit(every)) == 0)
    out: dict[tuple, np.ndarray] = {}
    for _ in range(ROUNDS):
        known = sc.broadcast(out)
        runs = sample.mapInPandas(hashing.places(known), "tree int, code long, sub array<long>").groupBy("tree", "code", "sub")
        hot = {(r["tree"], r["code"], *r["sub"]) for r in runs.count().where(F.col("count") * every > part_rows).collect()}
        if not hot:
            break
        sums = sample.mapInPandas(hashing.sums(known, sc.broadcast(hot)),
                                  "tree int, code long, sub array<long>, n long, total binary")
        means = sums.groupBy("tree", "code", "sub").applyInPandas(_centre, "tree int, code long, sub array<long>, centre binary")
        out = out | {(r["tree"], r["code"], *r["sub"]): np.frombuffer(r["centre"], np.float32) for r in means.collect()}
    return out


def _search(k: int, symbols: int, bits: int, candidates: int):
    """Range partition of sorted strings -> per (query, tree) its counts and best entries by level."""

    def best(q_ids, q_vecs, ids, vecs, q_code, d_code, lo, hi, level, counts):
        scores = q_vecs @ vecs[lo:hi].T
        run_ids, run_codes = ids[lo:hi], d_code[lo:hi]
        for i in range(len(q_ids)):
            keep = []
            for lv in range(level, symbols + 1):
                s = bits * (symbols - lv)
                m = (run_codes >> s) == (q_code[i] >> s)
                if lv < symbols:
                    m &= (run_codes >> (s - bits)) != (q_code[i] >> (s - bits))
                at = np.flatnonzero(m)
                if len(at) > k + 1:
                    sc = scores[i, at]
                    cut = np.partition(sc, len(sc) - k - 1)[len(sc) - k - 1]
                    at = at[sc >= cut]
                    at = at[np.lexsort((run_ids[at], -scores[i, at]))[:k + 1]]
                keep += [(lv, a) for a in at]
            a = np.array([x for _, x in keep], np.int64)
            yield (int(q_ids[i]), counts[i].astype("<i8").tobytes(), np.array([x for x, _ in keep], "u1").tobytes(),
                   run_ids[a].astype("<i8").tobytes(), scores[i, a].astype("<f8").tobytes())

    def run(batches):
        frames = [b for b in batches if len(b)]
        if not frames:
            return
        pdf = pd.concat(frames).sort_values(["tree", "code", "rep"], kind="stable")
        for _, part in pdf.groupby("tree", sort=True):
            asks = part["ask"].to_numpy(bool)
            data, query = part[~asks], part[asks]
            if not len(data) or not len(query):
                continue
            ids, d_code = data["rep"].to_numpy(np.int64), data["code"].to_numpy(np.int64)
            vecs = np.frombuffer(b"".join(data["vec"]), np.float64).reshape(len(data), -1)
            q_ids, q_code = query["rep"].to_numpy(np.int64), query["code"].to_numpy(np.int64)
            q_vecs = np.frombuffer(b"".join(query["vec"]), np.float64).reshape(len(query), -1)
            lo = np.empty((symbols + 1, len(query)), np.int64)
            hi = np.empty_like(lo)
            for lv in range(symbols + 1):
                s = bits * (symbols - lv)
                prefix = q_code >> s
                lo[lv], hi[lv] = np.searchsorted(d_code, prefix << s), np.searchsorted(d_code, (prefix + 1) << s)
            counts = hi - lo
            level = np.zeros(len(query), np.int64)
            for lv in range(1, symbols + 1):          # the deepest level that alone holds enough
                level[counts[lv] >= candidates] = lv
            at = np.arange(len(query))
            key = pd.DataFrame({"lo": lo[level, at], "hi": hi[level, at], "lv": level})
            rows = []
            for (a, b, lv), g in key.groupby(["lo", "hi", "lv"]):
                g = g.index.to_numpy()
                for i in range(0, len(g), 64):
                    j = g[i:i + 64]
                    rows += best(q_ids[j], q_vecs[j], ids, vecs, q_code[j], d_code, a, b, lv, counts[:, j].T)
                if len(rows) > 2000:
                    yield pd.DataFrame(rows, columns=["rep", "counts", "levels", "ids", "scores"])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["rep", "counts", "levels", "ids", "scores"])
    return run


def _ascend(k: int, symbols: int, candidates: int):
    """All trees of a query together: the level where they hold enough, then the best entries."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for rep, g in pdf.groupby("rep"):
            total = np.sum([np.frombuffer(c, "<i8") for c in g["counts"]], axis=0)
            enough = np.flatnonzero(total >= candidates)
            stop = int(enough[-1]) if len(enough) else 0
            lv = np.frombuffer(b"".join(g["levels"]), "u1")
            ids = np.frombuffer(b"".join(g["ids"]), "<i8")[lv >= stop]
            sc = np.frombuffer(b"".join(g["scores"]), "<f8")[lv >= stop]
            ids, first = np.unique(ids, return_index=True)
            sc = sc[first]
            order = np.lexsort((ids, -sc))[:k + 1]
            out.append(pd.DataFrame({"rep": int(rep), "near": ids[order], "score": sc[order]}))
        return pd.concat(out) if out else pd.DataFrame({"rep": [], "near": [], "score": []})
    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
            trees: int = TREES, symbols: int = SYMBOLS, candidates: int = CANDIDATES, dims: int | None = None,
            part_rows: int = 32_768, seed: int = 17) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of every query row.

    ``is_query`` is a condition on the column ``id``."""
    v, dims = usable(vectors, id_col, vec_col, dims)
    schema = "query_id long, rank int, vec_id long, score double"
    if dims == 0:
        return vectors.sparkSession.createDataFrame([], schema)
    v = v.withColumn("ask", is_query).distinct()
    small = Window.partitionBy("v").orderBy("id")
    groups = v.groupBy("v").agg(F.min("id").alias("rep"), F.max("ask").alias("ask"))
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    stat = groups.agg(F.max(norm2).alias("hi"), F.min(norm2).alias("lo"), F.count(F.lit(1)).alias("n")).first()
    if not stat["n"]:
        return vectors.sparkSession.createDataFrame([], schema)
    extra = stat["lo"] < stat["hi"] * (1 - 1e-5)
    bits = (2 * (dims + extra) - 1).bit_length()
    if bits * symbols > 62:
        raise ValueError("too many symbols for a 62-bit string")
    hashing = _Hash(dims, float(stat["hi"]) ** 0.5, extra, trees, symbols, seed)
    centres = _centres(groups, hashing, part_rows) if stat["n"] > part_rows else {}
    hashed = groups.mapInPandas(hashing.rows(vectors.sparkSession.sparkContext.broadcast(centres)),
                                "tree int, code long, sub array<long>, ask boolean, rep long, vec binary")
    hashed = hashed.withColumn("mixed", F.xxhash64("tree", "rep"))
    parts = max(1, -(-stat["n"] * trees // part_rows))
    found = hashed.repartitionByRange(parts, "tree", "code", "sub", "mixed").mapInPandas(
        _search(k, symbols, bits, candidates), "rep long, counts binary, levels binary, ids binary, scores binary")
    near = found.groupBy(F.pmod(F.xxhash64("rep"), F.lit(max(1, stat["n"] // 20_000)))).applyInPandas(
        _ascend(k, symbols, candidates), "rep long, near long, score double")
    # from distinct vectors back to rows: the smallest k+1 ids of a near vector, every query id
    ids = v.select("v", "id").distinct()
    first_ids = ids.withColumn("i", F.row_number().over(small)).where(F.col("i") <= k + 1).drop("i")
    rep = Window.partitionBy("v")
    members = first_ids.withColumn("near", F.min("id").over(rep)).select("near", F.col("id").alias("vec_id"))
    listed = near.join(members, "near").withColumn(
        "i", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id"))).where(F.col("i") <= k + 1)
    listed = listed.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("i", "vec_id", "score"))).alias("hits"))
    asking = v.where("ask").select("v", F.col("id").alias("query_id")).distinct().join(groups.select("v", "rep"), "v")
    out = asking.select("rep", "query_id").join(listed, "rep")
    others = F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, k)
    return out.select("query_id", F.posexplode(others).alias("p", "h")).select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("h.vec_id").alias("vec_id"),
        F.col("h.score").alias("score"))
