"""Nearest neighbours and user similarity, in blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block: 2 blocks of 4096 vectors of 3072 doubles take 200 MB.
BLOCK = 4096


def sample_order(c: Column) -> Column:
    """A portable pseudo-random order of ids."""
    return (c * 7919) % 1000003


def block_products(queries: DataFrame, vectors: DataFrame, reduce, schema: str, q_blocks: int = 1, v_blocks: int = 1) -> DataFrame:
    """Matrix products of query blocks and vector blocks, reduced inside each pair of blocks.

    ``queries``: q_id, q_user, v.  ``vectors``: c_id, c_user, v.  ``reduce(q, c, scores)`` gets
    two pandas frames and their products.  Every vector meets every query, block by block, so
    no task holds more than two blocks and no pair is written as a row before it is reduced.
    """
    q = queries.withColumn("qb", F.pmod(F.xxhash64("q_id", "q_user"), F.lit(q_blocks)).cast("int")).withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(v_blocks - 1))))
    # a new name: both sides may come from one table
    c = vectors.select("c_id", "c_user", F.transform("v", lambda x: x).alias("w")).withColumn("vb", F.pmod(F.xxhash64("c_id", "c_user"), F.lit(v_blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return reduce(a.iloc[:0], b.iloc[:0], np.empty((0, 0)))
        return reduce(a, b, np.stack(a["v"].to_numpy()) @ np.stack(b["w"].to_numpy()).T)

    return q.groupBy("qb", "vb").cogroup(c.groupBy("qb", "vb")).applyInPandas(run, schema)


def blocks_for(df: DataFrame) -> int:
    return max(1, -(-df.count() // BLOCK))


def nearest(queries: DataFrame, vectors: DataFrame, k: int, other_users: bool = False) -> DataFrame:
    """q_id, q_user, rank, c_id, c_user, score: the k largest inner products of each query.

    A query does not meet its own id, with ``other_users`` nor its own user's rows.
    """

    def top(q: pd.DataFrame, c: pd.DataFrame, s: np.ndarray) -> pd.DataFrame:
        out = []
        ids, users = c["c_id"].to_numpy(), c["c_user"].to_numpy()
        for i in range(len(q)):
            ok = ids != q["q_id"].iloc[i]
            if other_users:
                ok &= users != q["q_user"].iloc[i]
            at = np.flatnonzero(ok)
            if len(at) > k:  # ties with the k-th stay until the ids decide
                at = at[s[i, at] >= np.partition(s[i, at], -k)[-k]]
            at = at[np.lexsort((ids[at], -s[i, at]))[:k]]
            out.append(pd.DataFrame({"q_id": q["q_id"].iloc[i], "q_user": q["q_user"].iloc[i], "c_id": ids[at], "c_user": users[at], "score": s[i, at]}))
        return pd.concat(out) if out else pd.DataFrame({"q_id": [], "q_user": [], "c_id": [], "c_user": [], "score": []})

    best = block_products(queries, vectors, top, "q_id long, q_user long, c_id long, c_user long, score double", blocks_for(queries), blocks_for(vectors))
    w = Window.partitionBy("q_id", "q_user").orderBy(F.desc("score"), "c_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bucket_nearest(queries: DataFrame, vectors: DataFrame, k: int, tables: int = 8, bucket: float = 0.5, seed: int = 7) -> DataFrame:
    """q_id, rank, c_id, d: approximate nearest by Euclidean distance, by random projections.

    Candidates share a bucket with the query in one of ``tables``, at any distance; a query with
    fewer than ``k`` is filled up with the nearest of the others.  Buckets are met inside the
    blocks, so no candidate pair is a row before it is one of a block's ``k``.
    """

    def top(q: pd.DataFrame, c: pd.DataFrame, s: np.ndarray) -> pd.DataFrame:
        if not len(q):
            return pd.DataFrame({"q_id": [], "c_id": [], "apart": [], "d": []})
        a, b, ids = np.stack(q["v"].to_numpy()), np.stack(c["w"].to_numpy()), c["c_id"].to_numpy()
        planes = np.random.default_rng(seed).normal(size=(a.shape[1], tables))
        planes /= np.linalg.norm(planes, axis=0) * bucket
        apart = np.ones(s.shape, dtype=bool)
        for x, y in zip(np.floor(a @ planes).T, np.floor(b @ planes).T):
            apart &= x[:, None] != y[None]
        d = np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * s, 0))
        out = []
        for i, own in enumerate(q["q_id"]):
            at = np.flatnonzero(ids != own)
            at = at[np.lexsort((ids[at], d[i, at], apart[i, at]))[:k]]
            out.append(pd.DataFrame({"q_id": own, "c_id": ids[at], "apart": apart[i, at], "d": d[i, at]}))
        return pd.concat(out)

    best = block_products(queries, vectors, top, "q_id long, c_id long, apart boolean, d double", blocks_for(queries), blocks_for(vectors))
    w = Window.partitionBy("q_id")
    best = best.withColumn("_n", F.row_number().over(w.orderBy("apart", "d", "c_id"))).where(F.col("_n") <= k)
    return best.select("q_id", F.row_number().over(w.orderBy("d", "c_id")).alias("rank"), "c_id", "d")


def user_similarity(vectors: DataFrame, sample: int = 100) -> DataFrame:
    """user_id, other_id, similarity for all ordered pairs of users.

    For at most ``sample`` vectors of a user, the best inner product in the other user's set,
    averaged.  ``vectors``: user_id, conversation_id, v.
    """
    w = Window.partitionBy("user_id").orderBy(sample_order(F.col("conversation_id")), "conversation_id")
    q = vectors.withColumn("n", F.row_number().over(w)).where(F.col("n") <= sample)
    q = q.select(F.col("conversation_id").alias("q_id"), F.col("user_id").alias("q_user"), "v")
    c = vectors.select(F.col("conversation_id").alias("c_id"), F.col("user_id").alias("c_user"), "v")

    def best(q: pd.DataFrame, c: pd.DataFrame, s: np.ndarray) -> pd.DataFrame:
        if not len(q):
            return pd.DataFrame({"q_id": [], "q_user": [], "c_user": [], "score": []})
        users, at = np.unique(c["c_user"].to_numpy(), return_inverse=True)
        order = np.argsort(at, kind="stable")
        start = np.searchsorted(at[order], np.arange(len(users)))
        top = np.maximum.reduceat(s[:, order], start, axis=1)
        return pd.DataFrame({"q_id": np.repeat(q["q_id"].to_numpy(), len(users)), "q_user": np.repeat(q["q_user"].to_numpy(), len(users)), "c_user": np.tile(users, len(q)), "score": top.ravel()})

    per = block_products(q, c, best, "q_id long, q_user long, c_user long, score double", blocks_for(q), blocks_for(c))
    per = per.where("q_user <> c_user").groupBy("q_user", "c_user", "q_id").agg(F.max("score").alias("score"))
    return per.groupBy(F.col("q_user").alias("user_id"), F.col("c_user").alias("other_id")).agg(F.avg("score").alias("similarity"))


def top_users(pairs: DataFrame, k: int = 5) -> DataFrame:
    """The k most similar users of each user, with match_group_id = rank - 1."""
    w = Window.partitionBy("user_id").orderBy(F.desc(F.round("similarity", 9)), "other_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("match_group_id", F.col("rank") - 1)


def _centres(rows: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Plain k-means of a bounded sample."""
    c = rows[np.random.default_rng(5).choice(len(rows), k, replace=False)]
    for _ in range(rounds):
        near = ((c * c).sum(1)[None] - 2 * rows @ c.T).argmin(1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, rows)
        c = np.where(n[:, None] > 0, total / n.clip(1)[:, None], c)
    return c


def candidate_top_users(vectors: DataFrame, k: int = 5, sample: int = 100, candidates: int = 50, probes: int = 8, newest: int = 1500, max_sample: int = 20_000) -> DataFrame:
    """:func:`top_users` without meeting all pairs of users.

    Inverted lists (centres fitted on about ``max_sample`` vectors) give each of a user's at
    most ``sample`` query vectors the best of every other user's vectors in ``probes`` lists;
    the ``candidates`` users with the largest sums are then compared exactly, pair by pair, a
    pair being ``sample`` by ``newest`` vectors.  Work grows with the users, not with their
    square; a user who shares no list with another is not found, so recall is below one.
    """
    w = Window.partitionBy("user_id")
    v = vectors.withColumn("_r", F.row_number().over(w.orderBy(F.desc("conversation_id")))).where(F.col("_r") <= newest)
    v = v.select("user_id", "conversation_id", "v")
    q = v.withColumn("_r", F.row_number().over(w.orderBy(sample_order(F.col("conversation_id")), "conversation_id"))).where(F.col("_r") <= sample).drop("_r")
    n = v.count()
    part = F.pmod(F.xxhash64("user_id", "conversation_id"), F.lit(2**40)) < F.lit(min(2**40, int(2**40 * max_sample / max(1, n))))
    got = [r["v"] for r in v.where(part).select("v").limit(2 * max_sample).collect()]
    schema = "user_id long, other_id long, similarity double"
    if not got:
        return top_users(v.sparkSession.createDataFrame([], schema), k)
    lists = max(1, min(2048, int(np.sqrt(n)), len(got) // 8))
    c = _centres(np.array(got), lists)

    def assign(many: int):
        def run(frames):
            for pdf in frames:
                if len(pdf):
                    d = (c * c).sum(1)[None] - 2 * np.stack(pdf["v"].to_numpy()) @ c.T
                    at = np.argsort(d, axis=1, kind="stable")[:, :many]
                    out = pdf.loc[pdf.index.repeat(at.shape[1])]
                    yield out.assign(list=at.ravel().astype("int64"))

        return run

    wide = "user_id long, conversation_id long, v array<double>, list long"
    # a list is dealt in blocks of its members, each of which meets the list's queries in blocks
    held = v.mapInPandas(assign(1), wide)
    blocks = held.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_b"))
    asked = q.mapInPandas(assign(min(probes, lists)), wide)
    parts = blocks.join(asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_q")), "list")
    left = asked.join(parts, "list").select("user_id", "conversation_id", "v", "list", F.pmod(F.xxhash64("conversation_id"), "_q").alias("_q"), F.explode(F.sequence(F.lit(0), F.col("_b") - 1)).alias("_b"))
    right = held.join(parts, "list").select(F.col("user_id").alias("other_id"), F.col("v").alias("w"), "list", F.explode(F.sequence(F.lit(0), F.col("_q") - 1)).alias("_q"), F.pmod(F.xxhash64("conversation_id"), "_b").alias("_b"))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"user_id": [], "conversation_id": [], "other_id": [], "s": []})
        users, at = np.unique(b["other_id"].to_numpy(), return_inverse=True)
        order = np.argsort(at, kind="stable")
        s = np.stack(a["v"].to_numpy()) @ np.stack(b["w"].to_numpy())[order].T
        top = np.maximum.reduceat(s, np.searchsorted(at[order], np.arange(len(users))), axis=1)
        return pd.DataFrame({"user_id": np.repeat(a["user_id"].to_numpy(), len(users)), "conversation_id": np.repeat(a["conversation_id"].to_numpy(), len(users)), "other_id": np.tile(users, len(a)), "s": top.ravel()})

    near = left.groupBy("list", "_q", "_b").cogroup(right.groupBy("list", "_q", "_b")).applyInPandas(best, "user_id long, conversation_id long, other_id long, s double")
    near = near.where("user_id <> other_id").groupBy("user_id", "conversation_id", "other_id").agg(F.max("s").alias("s"))
    near = near.groupBy("user_id", "other_id").agg(F.sum(F.greatest("s", F.lit(0.0))).alias("s"))
    pairs = near.withColumn("_r", F.row_number().over(w.orderBy(F.desc("s"), "other_id"))).where(F.col("_r") <= candidates).select("user_id", "other_id")

    def exact(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        s = np.stack(a["v"].to_numpy()) @ np.stack(b["w"].to_numpy()).T
        return pd.DataFrame({"user_id": a["user_id"].iloc[:1].to_numpy(), "other_id": a["other_id"].iloc[:1].to_numpy(), "similarity": [s.max(1).mean()]})

    mine = pairs.join(q, "user_id").select("user_id", "other_id", "v")
    theirs = pairs.join(v.select(F.col("user_id").alias("other_id"), F.col("v").alias("w")), "other_id").select(F.col("user_id").alias("me"), F.col("other_id").alias("them"), "w")
    return top_users(mine.groupBy("user_id", "other_id").cogroup(theirs.groupBy("me", "them")).applyInPandas(exact, schema), k)


def mixed_threshold(hits: DataFrame, by: str, distance: str, limit: float) -> DataFrame:
    """Where a result has rows within and beyond ``limit``, keep those within; else all."""
    w = Window.partitionBy(by)
    within = F.col(distance) <= limit
    return hits.withColumn("_some", F.bool_or(within).over(w)).withColumn("meets", within).where(~F.col("_some") | F.col("meets")).drop("_some")


def optimal_matching(s: np.ndarray) -> float:
    """Mean similarity of the best one-to-one matching of rows and columns (Hungarian)."""
    cost = -(s if s.shape[0] <= s.shape[1] else s.T)
    n, m = cost.shape
    if n == 0:
        return float("nan")
    u, v, p, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        p[0], j0 = i, 0
        low, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool)
        while True:
            used[j0] = True
            cur = cost[p[j0] - 1] - u[p[j0]] - v[1:]
            free = ~used[1:]
            better = free & (cur < low[1:])
            low[1:][better], way[1:][better] = cur[better], j0
            j1 = int(np.where(free, low[1:], np.inf).argmin()) + 1
            delta = low[j1]
            u[p[used]] += delta
            v[used] -= delta
            low[~used] -= delta
            j0 = j1
            if p[j0] == 0:
                break
        while j0:
            p[j0] = p[way[j0]]
            j0 = way[j0]
    return float(v[0] / n)


def matched_similarity(members: DataFrame, group: list[str], side: str, v: str = "v") -> DataFrame:
    """Mean similarity of the optimal matching of both sides of each (bounded) group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (np.stack(x.to_numpy()) if len(x) else None for x in (pdf.loc[pdf[side], v], pdf.loc[~pdf[side], v]))
        out = pdf[group].iloc[:1].copy()
        out["similarity"] = optimal_matching(a @ b.T) if a is not None and b is not None else None
        return out

    kinds = dict(members.dtypes)
    return members.groupBy(*group).applyInPandas(run, ", ".join(f"{g} {kinds[g]}" for g in group) + ", similarity double")
