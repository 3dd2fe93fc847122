"""Approximate nearest neighbours by inner product: inverted lists with adaptive dimension scan.

Vectors of one length have one index.  Within it they are classed by the power of two nearest
to their norm, and each class is scaled by that power and lifted: one more coordinate makes
all its norms equal, so that the largest inner product is the least distance.  One huge
vector therefore costs the others neither range nor precision.  Every class has inverted
lists of its own; the columns are rotated at random and scanned in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, discard, written


@dataclass
class AnnIndex:
    """What every task needs: bounded by the lists, the sample and the dimension."""

    rotation: np.ndarray  # random orthogonal matrix of the lifted space
    centroids: np.ndarray  # of the inverted lists, in the rotated space
    power: np.ndarray  # the class (power of two) of every list
    tops: dict[int, float]  # largest scaled norm of every class
    sample: np.ndarray  # original vectors of a bounded sample, for first thresholds
    sample_ids: np.ndarray
    probes: int
    epsilon: float  # width of the hypothesis test

    def lift(self, x: np.ndarray, power: int) -> np.ndarray:
        """Vectors of one class: scaled, with the coordinate that makes norms equal, rotated."""
        x = np.ldexp(x, -power)
        extra = np.sqrt(np.maximum(self.tops[power] ** 2 - (x * x).sum(1, keepdims=True), 0))
        return np.hstack([x, extra]) @ self.rotation

    def lift_queries(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries scaled by their own powers and rotated; and the powers."""
        power = powers(q)
        return np.hstack([np.ldexp(q, -power[:, None]), np.zeros((len(q), 1))]) @ self.rotation, power

    def nearest_list(self, x: np.ndarray, power: np.ndarray) -> np.ndarray:
        own = np.empty(len(x), dtype=np.int32)
        for p in np.unique(power):
            lists = np.flatnonzero(self.power == p)
            c = self.centroids[lists]
            at = np.flatnonzero(power == p)
            for i in range(0, len(at), 4096):
                some = at[i : i + 4096]
                own[some] = lists[((c * c).sum(1)[None] - 2 * self.lift(x[some], int(p)) @ c.T).argmin(1)]
        return own

    def order(self, lifted: np.ndarray) -> np.ndarray:
        """The lists of each query, best first, by the inner product that their distance means."""
        top = np.array([self.tops[int(p)] for p in self.power])
        with np.errstate(over="ignore"):
            worth = np.ldexp(lifted @ self.centroids.T + (top**2 - (self.centroids**2).sum(1)) / 2, self.power)
        return np.argsort(-worth, axis=1, kind="stable")


def powers(x: np.ndarray) -> np.ndarray:
    """The class of every row: its norm is 2**power times 0.7 to 1.42."""
    most = np.abs(x).max(1)
    return np.floor(np.log2(most) + 0.5 * np.log2(((x / most[:, None]) ** 2).sum(1)) + 0.5).astype(int)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products in double precision; one that is no number comes last."""
    with np.errstate(over="ignore", invalid="ignore"):
        s = a @ b.T
    return np.where(np.isnan(s), -np.inf, s)


def _spread(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Plain k-means on the sample."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([((c * c).sum(1)[None] - 2 * sample[i : i + 4096] @ c.T).argmin(1) for i in range(0, len(sample), 4096)])
        n = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        start = np.r_[0, np.cumsum(n)[:-1]]
        total = np.add.reduceat(sample[order], np.minimum(start, len(sample) - 1), axis=0)
        c = np.where(n[:, None] > 0, total / n.clip(1)[:, None], c)
    return c


def fit_index(vectors: DataFrame, dim: int, classes: dict[int, tuple[int, float]], k: int, max_sample: int, max_lists: int, recall: float = 0.97, epsilon: float = 2.1) -> AnnIndex:
    """Fit on a sample of about ``max_sample`` vectors (taken by a hash), or eight for each list
    if that is more; index nothing yet.

    The number of lists is about the square root of the rows, at most ``max_lists``: so long
    the work for a query grows with the square root too.  The number of probes is the least
    that finds ``recall`` of the sample's own neighbours.
    """
    rows = sum(n for n, _ in classes.values())
    max_sample = max(max_sample, 8 * min(max_lists, int(np.sqrt(rows))))
    part = F.pmod(F.xxhash64("_id", "_v"), F.lit(2**40)) < F.lit(min(2**40, int(2**40 * max_sample / rows)))
    got = vectors.where(part).select("_id", "_v").limit(2 * max_sample).toArrow()
    sample, ids = matrix(got.column("_v"), dim), got.column("_id").to_numpy()
    rng = np.random.default_rng(11)
    rotation = np.linalg.qr(rng.standard_normal((dim + 1, dim + 1)))[0]
    index = AnnIndex(rotation, np.zeros((0, dim + 1)), np.zeros(0, dtype=int), {p: top for p, (_, top) in classes.items()}, sample, ids, 1, epsilon)
    own = powers(sample) if len(sample) else np.empty(0, dtype=int)
    centroids, power = [], []
    for p, (n, _) in sorted(classes.items()):
        distinct = np.unique(index.lift(sample[own == p], p), axis=0)
        if len(distinct) == 0:  # a class too small for the sample has one list
            distinct = index.lift(np.zeros((1, dim)), p)
        lists = max(1, min(int(max_lists * n / rows), int(np.sqrt(n)), len(distinct) // 4))
        centroids.append(_spread(distinct, lists))
        power += [p] * lists
    index.centroids, index.power = np.concatenate(centroids), np.array(power)
    # probes: where, in the order of lists, lie the true neighbours of some of the sample
    ask = np.arange(min(len(sample), 400))
    if len(sample) > 1:
        score = products(sample[ask], sample)
        score[ids[ask][:, None] == ids[None]] = -np.inf
        want = np.argsort(-score, axis=1)[:, : min(k, len(sample) - 1)]
        place = np.argsort(index.order(index.lift_queries(sample[ask])[0]), axis=1)
        depth = np.sort(place[ask[:, None], index.nearest_list(sample, own)[want]].ravel())
        index.probes = int(min(len(power), depth[min(len(depth) - 1, int(np.ceil(recall * len(depth))))] + 1))
    return index


def matrix(column, dim: int) -> np.ndarray:
    """Rows of a list column, all of length ``dim``."""
    if isinstance(column, pa.ChunkedArray):
        return np.concatenate([matrix(c, dim) for c in column.chunks]) if column.num_chunks else np.zeros((0, dim))
    return np.asarray(column.flatten(), dtype=float).reshape(-1, dim)


def scan_block(index: AnnIndex, q: np.ndarray, x: np.ndarray, ids: np.ndarray, own: np.ndarray, floor: np.ndarray, power: int, k: int, epsilon: float, block: int = 16):
    """Adaptive scan of one block of a list for some queries.

    ``floor`` is each query's inner product that its k-th neighbour reaches at least.  It
    gives the distance ``r``; after each column block of d of D rotated coordinates, a
    candidate whose partial squared distance exceeds r * (1 + epsilon / sqrt(d))**2 * d / D
    is abandoned (at d = D, or with an infinite ``epsilon``: exceeds r).  Survivors get their
    exact inner product on the original vectors.  Yields (query position, vec ids, scores), k
    best each.
    """
    lq, qp = index.lift_queries(q)
    lx = index.lift(x, power)
    dims, top = lq.shape[1], index.tops[power]
    r = (lq * lq).sum(1) + top * top
    with np.errstate(over="ignore"):
        r = r - 2 * np.ldexp(np.maximum(floor, -np.inf).clip(max=1e300), -(qp + power)) + 1e-9 * (1 + r)

    def limit(r: np.ndarray, d: int) -> np.ndarray:
        return r if d == dims or np.isinf(epsilon) else np.where(r > 0, r * ((1 + epsilon / np.sqrt(d)) ** 2 * d / dims), r)

    d = min(block, dims)
    part = ((lq[:, :d] ** 2).sum(1)[:, None] + (lx[:, :d] ** 2).sum(1)[None]) - 2 * lq[:, :d] @ lx[:, :d].T
    i, j = np.nonzero(part <= limit(r, d)[:, None])
    dist = part[i, j]
    while d < dims and len(i):
        e = min(d + block, dims)
        # pairs in pieces, so that memory stays bounded
        dist = dist + np.concatenate([((lq[i[s : s + 65536], d:e] - lx[j[s : s + 65536], d:e]) ** 2).sum(1) for s in range(0, len(i), 65536)])
        d = e
        alive = dist <= limit(r[i], d)
        i, j, dist = i[alive], j[alive], dist[alive]
    other = ids[j] != own[i]
    i, j = i[other], j[other]
    if not len(i):
        return
    # each product is summed alone, so equal vectors get equal scores wherever they stand
    with np.errstate(over="ignore", invalid="ignore"):
        score = np.concatenate([np.multiply(q[i[s : s + 65536]], x[j[s : s + 65536]]).sum(1) for s in range(0, len(i), 65536)])
    order = np.lexsort((ids[j], -np.where(np.isnan(score), -np.inf, score), i))
    i, j, score = i[order], j[order], score[order]
    start = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    for a, b in zip(start, np.r_[start[1:], len(i)]):
        b = min(b, a + k)
        yield int(i[a]), ids[j[a:b]], score[a:b]


def usable(v: Column) -> Column:
    """Whether a vector is not null, empty or zero and has finite components only."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return v.isNotNull() & F.coalesce(fine, F.lit(False))


def search(vectors: DataFrame, k: int = 20, query_every: int = 20, block_rows: int = 4096, max_sample: int = 20_000, max_lists: int = 16_384) -> DataFrame:
    """The ``k`` nearest other rows by inner product of every row whose id is divisible.

    ``vectors``: vec_id, embedding; other columns are not read.  Rows with a null id, a null,
    empty or zero vector, or a null or non-finite component take no part; an empty table gives
    no rows.  Vectors meet those of their own length only, and each length has an index
    (lengths are taken one after the other).  Every row is indexed: it belongs to its nearest
    list.  A query meets the ``probes`` lists that promise most; lists, and the queries of a
    list, are dealt out in blocks of about ``block_rows`` by a hash of the id, so that a list
    with a third of all rows or queries is many tasks.  The k best of each block are reduced
    before they are shuffled.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id, and a
    product that is no number comes last.  A query with fewer than k candidates in its lists
    is scanned against all lists without the test.  Rows that repeat a vec_id are candidates
    one by one, are one query (with the least of their vectors), and do not meet themselves.
    """
    v = columns(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("_id"), F.col("embedding").cast("array<double>").alias("_v"))
    v = v.where(F.col("_id").isNotNull() & usable(F.col("_v")))
    most = F.array_max(F.transform("_v", lambda x: F.abs(x)))
    norm = F.log2(most) + 0.5 * F.log2(F.aggregate("_v", F.lit(0.0), lambda s, x: s + (x / most) * (x / most)))
    v = v.withColumn("_n", norm).withColumn("_p", F.floor(F.col("_n") + 0.5).cast("int"))
    classes: dict[int, dict[int, tuple[int, float]]] = {}
    # a row for each length and power of two
    for r in v.groupBy(F.size("_v").alias("dim"), "_p").agg(F.count(F.lit(1)).alias("n"), F.max("_n").alias("top")).collect():
        classes.setdefault(r["dim"], {})[r["_p"]] = (r["n"], float(2 ** (r["top"] - r["_p"]) * (1 + 1e-9)))
    found = None
    for dim in sorted(classes):
        part = _search_length(v.where(F.size("_v") == dim).select("_id", "_v", "_p"), dim, classes[dim], k, query_every, block_rows, max_sample, max_lists)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return found


def _search_length(v: DataFrame, dim: int, classes: dict[int, tuple[int, float]], k: int, query_every: int, block_rows: int, max_sample: int, max_lists: int) -> DataFrame:
    rows = sum(n for n, _ in classes.values())
    index = fit_index(v, dim, classes, k, max_sample, max_lists)
    held = v.sparkSession.sparkContext.broadcast(index)  # at most (lists + sample + dim) * dim doubles

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = held.value.nearest_list(matrix(b.column(1), dim), b.column(2).to_numpy()) if b.num_rows else np.empty(0, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own)], ["_id", "_v", "_list"])

    listed = written(v.mapInArrow(assign, "_id long, _v array<double>, _list int"))

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("_list").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias(name))

    def ask(probes: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ix = held.value
            for b in batches:
                for lo in range(0, b.num_rows, 256):
                    part = b.slice(lo, 256)
                    q, ids = matrix(part.column(1), dim), part.column(0).to_numpy()
                    known = products(q, ix.sample)
                    known[ids[:, None] == ix.sample_ids[None]] = -np.inf
                    floor = np.partition(known, -k, axis=1)[:, -k] if known.shape[1] >= k else np.full(len(q), -np.inf)
                    order = ix.order(ix.lift_queries(q)[0])[:, :probes]
                    at = np.repeat(np.arange(len(q)), order.shape[1])
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(at)), pa.array(order.ravel().astype(np.int32)), pa.array(floor[at])], ["_id", "_list", "_floor"]
                    )

        return run

    data_blocks = blocks(listed, "_xb")

    def found(queries: DataFrame, probes: int, epsilon: float) -> DataFrame:
        asked = written(queries.mapInArrow(ask(probes), "_id long, _list int, _floor double"))
        # a row a list: lists without rows are not met
        counts = written(data_blocks.join(blocks(asked, "_qb"), "_list"))
        left = asked.join(counts, "_list").join(queries.select("_id", F.col("_v").alias("_q")), "_id")
        left = left.select(F.col("_id").alias("_own"), "_q", "_floor", "_list", F.pmod(F.xxhash64("_id"), F.col("_qb")).cast("int").alias("_qb"), F.explode(F.sequence(F.lit(0), F.col("_xb") - 1)).alias("_xb"))
        right = listed.join(counts, "_list")
        right = right.select("_id", "_v", "_list", F.explode(F.sequence(F.lit(0), F.col("_qb") - 1)).alias("_qb"), F.pmod(F.xxhash64("_id"), F.col("_xb")).cast("int").alias("_xb"))

        def scan(a: pa.Table, b: pa.Table) -> pa.Table:
            own, ids, score = [], [], []
            if len(a) and len(b):
                ix, at = held.value, b.column("_list")[0].as_py()
                x, x_ids, qs, q_ids, floor = matrix(b.column("_v"), dim), b.column("_id").to_numpy(), matrix(a.column("_q"), dim), a.column("_own").to_numpy(), a.column("_floor").to_numpy()
                for lo in range(0, len(qs), 256):
                    some = slice(lo, lo + 256)
                    for i, got, s in scan_block(ix, qs[some], x, x_ids, q_ids[some], floor[some], int(ix.power[at]), k, epsilon):
                        own.append(np.full(len(got), q_ids[lo + i]))
                        ids.append(got)
                        score.append(s)
            none = [np.empty(0)]
            return pa.table({"_own": pa.array(np.concatenate(own or none), pa.int64()), "_id": pa.array(np.concatenate(ids or none), pa.int64()), "_s": pa.array(np.concatenate(score or none), pa.float64())})

        out = left.groupBy("_list", "_qb", "_xb").cogroup(right.groupBy("_list", "_qb", "_xb")).applyInArrow(scan, "_own long, _id long, _s double")
        out = written(out)
        discard(asked, counts)
        return out

    queries = written(listed.where(F.col("_id") % query_every == 0).groupBy("_id").agg(F.min("_v").alias("_v")))
    first = found(queries, index.probes, index.epsilon)
    if index.probes < len(index.centroids):
        enough = first.groupBy(F.col("_own").alias("_id")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(k, rows - 1))
        short = written(queries.join(enough, "_id", "left_anti"))
        if not short.isEmpty():
            first = first.join(short.select(F.col("_id").alias("_own")), "_own", "left_anti").unionByName(found(short, len(index.centroids), np.inf))
    best = Window.partitionBy("_own").orderBy(F.isnan("_s"), F.desc("_s"), "_id")
    ranked = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.col("_own").alias("query_id"), "rank", F.col("_id").alias("vec_id"), F.col("_s").alias("score"))
