"""Optimal one-to-one matching of the two sides of groups of any size, by auction.

The rows of the smaller side bid for those of the larger one.  A bidder knows its nearest
objects, with a bound on what all others can be worth to it, and asks for more of them when
none of the known ones is worth more than that bound.  In every round the bidders without an
object bid in blocks, beside the owners of the objects that they may take; a block plays its
auction to the end, then each object goes to its highest bid of all blocks.  Prices only rise,
and start at nought, as those of objects that stay free have to.  (For that reason there are no
rounds with a coarser step before: their prices would be left on free objects.)  A group that a
task holds is one block whose bidders know all objects: a task plays many such groups.

Nobody prefers another object to its own by more than ``gap``, so the mean similarity is within
``gap`` of the best one; the prices give an upper bound, which is returned beside it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import usable
from .density import in_blocks
from .tables import in_groups, saver, whole_groups

#: Bidders of a block, and rows of a group that a task plays whole.
BIDDERS = 4096

#: Times that bidders of a whole group bid before shortest paths end its matching.
ROUNDS = 300


def nearest_objects(bidders: DataFrame, objects: DataFrame, known: int) -> DataFrame:
    """(g, i, js, ss, t): the ``known`` objects nearest to each bidder (g, i, v) and what any
    other is worth at most; equally near ones in an order of the bidder's own."""

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"g": [], "i": [], "j": [], "s": [], "o": []})
        i, j = a["i"].to_numpy().astype(np.uint64), b["i"].to_numpy().astype(np.uint64)
        right, m, parts = np.stack(b["v"].to_numpy()).T, min(known, len(b)), []
        for lo in range(0, len(a), 512):
            s = np.stack(a["v"].iloc[lo : lo + 512].to_numpy()) @ right
            with np.errstate(over="ignore"):
                o = (j[None] * np.uint64(0x9E3779B97F4A7C15) + i[lo : lo + 512, None] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(33)
            at = np.argpartition(-s, m - 1, axis=1)[:, :m]
            last = np.take_along_axis(s, at, 1).min(1)
            tied = np.flatnonzero((s >= last[:, None]).sum(1) > m)
            at[tied] = np.lexsort((o[tied], -s[tied]), axis=1)[:, :m]
            row = np.repeat(np.arange(len(s)), m)
            at = at.ravel()
            parts.append(pd.DataFrame({"i": a["i"].to_numpy()[lo + row], "j": b["i"].to_numpy()[at], "s": s[row, at], "o": o[row, at].astype(np.int64)}))
        return pd.concat(parts).assign(g=a["g"].iloc[0])[["g", "i", "j", "s", "o"]]

    found = in_blocks(bidders, objects, nearest, "g long, i long, j long, s double, o long")
    w = Window.partitionBy("i").orderBy(F.desc("s"), "o", "j")
    found = found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= known)
    lists = found.groupBy("g", "i").agg(F.sort_array(F.collect_list(F.struct("_n", "j", "s"))).alias("l"))
    total = objects.groupBy("g").agg(F.count(F.lit(1)).alias("_m"))
    rest = F.when(F.size("l") < F.col("_m"), F.element_at("l", -1)["s"]).otherwise(F.lit(float("-inf")))
    return lists.join(total, "g").select("g", "i", F.col("l.j").alias("js"), F.col("l.s").alias("ss"), rest.alias("t"))


def play(at: np.ndarray, worth: np.ndarray, floor: np.ndarray, price: np.ndarray, owner: np.ndarray, gap: float, most: float = np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(price, owner, asks) when no bidder that still bids is without an object, or after ``most`` times.

    ``at`` and ``worth``: a row for each bidder, objects and their worth to it (-inf: none);
    ``floor``: bound on the worth of other objects; ``owner``: bidder of each object, -1 of
    none, -2 of one that does not play here.  ``asks`` are the bidders that need more objects.
    """
    price, owner, n = price.copy(), owner.copy(), len(at)
    gap = max(gap, 1e-12 * np.abs(worth[np.isfinite(worth)]).max(initial=0.0))  # a step that the prices can hold
    has, asks = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    has[owner[owner >= 0]] = True
    while True:
        who = np.flatnonzero(~has & ~asks)
        if not len(who) or most <= 0:
            return price, owner, asks
        most -= 1
        net = worth[who] - price[at[who]]
        best = net.argmax(1)
        row = np.arange(len(who))
        first = net[row, best]
        net[row, best] = -np.inf
        second = np.maximum(net.max(1), floor[who])
        asks[who[first < floor[who]]] = True
        ok = first >= floor[who]
        who, target = who[ok], at[who[ok], best[ok]]
        lead = np.where(np.isfinite(second[ok]), first[ok] - second[ok], 0.0)
        bid = price[target] + lead + gap
        order = np.lexsort((who, -bid, target))
        top = order[np.r_[True, target[order][1:] != target[order][:-1]]] if len(order) else order
        lost = owner[target[top]]
        has[lost[lost >= 0]] = False
        price[target[top]], owner[target[top]] = bid[top], who[top]
        has[who[top]] = True


def _block(lists: pd.DataFrame, prices: pd.DataFrame, gap: float) -> pd.DataFrame:
    """Bids of a block: (j, p, i) of objects whose price rose, and (i) alone of bidders that ask."""
    none = pd.DataFrame({"g": [], "i": [], "j": [], "p": []})
    if not len(lists):
        return none
    lists = lists.sort_values("i", kind="stable")
    ids = lists["i"].to_numpy()
    objects, flat = np.unique(np.concatenate(lists["js"].to_list()), return_inverse=True)
    size = lists["js"].map(len).to_numpy()
    at, worth = np.zeros((len(ids), size.max()), dtype=int), np.full((len(ids), size.max()), -np.inf)
    held = np.arange(size.max())[None] < size[:, None]
    at[held], worth[held] = flat, np.concatenate(lists["ss"].to_list())
    price, owner = np.zeros(len(objects)), np.full(len(objects), -1)
    if len(prices):
        k = np.searchsorted(objects, prices["j"].to_numpy())
        price[k] = prices["p"].to_numpy()
        o = np.searchsorted(ids, prices["owner"].to_numpy()).clip(max=len(ids) - 1)
        owner[k] = np.where(ids[o] == prices["owner"].to_numpy(), o, -2)
    new, now, asks = play(at, worth, lists["t"].to_numpy(), price, owner, gap)
    rose = np.flatnonzero(new > price)
    taken = pd.DataFrame({"i": ids[now[rose]], "j": objects[rose], "p": new[rose]})
    more = pd.DataFrame({"i": ids[asks], "j": pd.NA, "p": np.nan})
    out = pd.concat([x for x in (taken, more) if len(x)]) if len(taken) or len(more) else none
    return out.assign(g=lists["g"].iloc[0], j=out["j"].astype("Int64"))[["g", "i", "j", "p"]]


def auction(bidders: DataFrame, objects: DataFrame, gap: float, save: saver, known: int = 16) -> tuple[DataFrame, DataFrame]:
    """(prices, lists): prices (g, j, p, owner) of the objects that bidders got, and each
    bidder's objects.  Both tables (g, i, v) are written ones, i unique over all groups, and no
    group has more bidders than objects."""
    lists = save(nearest_objects(bidders, objects, known))
    prices = save(lists.select("g", F.col("i").alias("j"), F.lit(0.0).alias("p"), F.col("i").alias("owner")).limit(0))
    while True:
        free = save(lists.join(prices.select(F.col("owner").alias("i")), "i", "left_anti").select("g", "i", "js", "ss", "t"))
        counts = free.groupBy("g").agg(F.count(F.lit(1)).alias("_c"))
        most = counts.agg(F.max("_c")).first()[0]
        if not most:
            save.drop(free)
            return prices, lists
        nb = F.ceil(F.col("_c") / BIDDERS)
        blocks = free.join(counts, "g").select("g", F.pmod(F.xxhash64("i"), nb).cast("int").alias("b"), "i", "js", "ss", "t")
        reach = most
        while True:  # owners of what the block may take play as well, and theirs, while they are few
            wanted = blocks.select("b", F.explode("js").alias("j")).groupBy("j").agg(F.min("b").alias("b"))
            owners = wanted.join(prices, "j").select("b", F.col("owner").alias("i"))
            owners = owners.join(blocks.select("i"), "i", "left_anti")
            blocks = save(blocks.unionByName(lists.join(owners, "i").select("g", "b", "i", "js", "ss", "t")))
            reach *= known
            if reach > BIDDERS:
                break
        at = blocks.select(F.col("b").alias("_b"), F.explode("js").alias("j")).distinct().join(prices, "j").select(F.col("g").alias("_g"), "_b", "j", "p", "owner")
        bids = save(blocks.groupBy("g", "b").cogroup(at.groupBy("_g", "_b")).applyInPandas(lambda a, b: _block(a, b, gap), "g long, i long, j long, p double"))
        top = F.max(F.struct("p", (-F.col("owner")).alias("_o"))).alias("_t")
        every = prices.unionByName(bids.where("j is not null").select("g", "j", "p", F.col("i").alias("owner")))
        won = save(every.groupBy("g", "j").agg(top).select("g", "j", F.col("_t.p").alias("p"), (-F.col("_t._o")).alias("owner")))
        asking = save(lists.join(bids.where("j is null").select("i"), "i", "left_semi").select("g", "i", F.size("js").alias("n")))
        deepest = asking.agg(F.max("n")).first()[0]
        if deepest:
            again = nearest_objects(bidders.join(asking.select("i"), "i", "left_semi").select("g", "i", "v"), objects, 4 * deepest)
            wider = save(lists.join(asking.select("i"), "i", "left_anti").select(*lists.columns).unionByName(again))
            save.drop(lists)
            lists = wider
        save.drop(free, prices, bids, asking)
        prices = won


def shortest_paths(s: np.ndarray, price: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(price, owner) when every bidder has an object: those without one get it by the shortest
    paths of exchanges, from an auction's prices.  What an owner has given up for its object, the
    gap at most, counts as worth of that object, so the gap holds for the result."""
    n, m = s.shape
    cost = np.hstack([np.zeros((n, 1)), -s])  # objects from 1; 0 holds the bidder that looks for one
    u, v, way = (cost[:, 1:] + price).min(1), np.r_[0.0, -price], np.zeros(m + 1, dtype=int)
    p = np.r_[-1, owner]
    taken = np.flatnonzero(p >= 0)
    cost[p[taken], taken] = u[p[taken]] + v[taken]
    for i in np.setdiff1d(np.arange(n), p):
        p[0], j = i, 0
        low, free = np.full(m + 1, np.inf), np.ones(m + 1, dtype=bool)
        while p[j] >= 0:
            free[j] = False
            now = cost[p[j]] - u[p[j]] - v
            nearer = free & (now < low)
            low[nearer], way[nearer] = now[nearer], j
            j = int(np.where(free, low, np.inf).argmin())
            step, used = low[j], ~free
            u[p[used]] += step
            v[used] -= step
            low[free] -= step
        while j:
            p[j] = p[way[j]]
            j = way[j]
    return -v[1:], p[1:]


def play_whole(s: np.ndarray, gap: float) -> tuple[float, float]:
    """(similarity, upper) of all products ``s`` of a group, no fewer objects than bidders.

    Bidders look through the objects from different ones on, so that equally near ones do not
    draw all bidders to the first.  Where many bidders want the same few objects, prices rise by
    steps of the gap for long; then shortest paths end the matching.
    """
    n, m = s.shape
    at = (np.arange(n)[:, None] * m // n + np.arange(m)) % m
    price, owner, _ = play(at, np.take_along_axis(s, at, 1), np.full(n, -np.inf), np.zeros(m), np.full(m, -1), gap, ROUNDS)
    if (owner >= 0).sum() < n:
        price, owner = shortest_paths(s, price, owner)
    taken = np.flatnonzero(owner >= 0)
    return s[owner[taken], taken].mean(), ((s - price).max(1).sum() + price[taken].sum()) / n


def _in_one_stream(points: DataFrame, gap: float) -> DataFrame:
    """g, pairs, similarity, upper of groups that a task holds, many of them in one call."""

    def run(batches):
        for table, start, size in whole_groups(batches):
            g, bids, out = table["g"].to_numpy(), table["bids"].to_numpy(), []
            for at, n in zip(start.tolist(), size.tolist()):
                x, b = np.stack(table["v"].slice(at, n).to_numpy()), bids[at : at + n].astype(bool)
                out.append((g[at], b.sum(), *play_whole(x[b] @ x[~b].T, gap)))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["g", "pairs", "similarity", "upper"]), preserve_index=False)

    return in_groups(points, ["g"], [F.col("i")]).mapInArrow(run, "g long, pairs long, similarity double, upper double")


def _in_rounds(points: DataFrame, gap: float, save: saver, known: int) -> DataFrame:
    """g, pairs, similarity, upper of groups of any size."""
    bidders, objects = points.where("bids").drop("bids"), points.where("not bids").drop("bids")
    prices, lists = auction(bidders, objects, gap, save, known)
    edges = lists.select("g", "i", "t", F.explode(F.arrays_zip("js", "ss")).alias("e")).select("g", "i", "t", F.col("e.js").alias("j"), F.col("e.ss").alias("s"))
    priced = edges.join(prices.select("j", "p", "owner"), "j", "left")
    net = F.col("s") - F.coalesce("p", F.lit(0.0))
    mine = F.max(F.when(F.col("owner") == F.col("i"), F.col("s")))
    each = priced.groupBy("g", "i").agg(F.greatest(F.max(net), F.max("t")).alias("u"), mine.alias("s"), F.max(F.when(F.col("owner") == F.col("i"), F.col("p"))).alias("p"))
    return each.groupBy("g").agg(F.count("s").alias("pairs"), F.avg("s").alias("similarity"), ((F.sum("u") + F.sum("p")) / F.count(F.lit(1))).alias("upper"))


def auction_matching(members: DataFrame, group: list[str], side: str, v: str = "v", gap: float = 1e-3, known: int = 16, save: saver | None = None) -> DataFrame:
    """group, pairs, similarity, upper: for each group the mean similarity (inner product) of a
    matching of its two sides, and what the best one has at most; ``upper - similarity <= gap``
    up to rounding.

    Each row of the smaller side has one of the larger.  Groups of any size, repeated rows and
    null group values included; rows with a null side or vector, or with a component that is null,
    not finite or beyond 1e150, take no part, and a group without rows on one side has 0 pairs and
    null similarity.  Of products above 1e12 gaps the gap is 1e-12 of the largest.  All products of a group are computed
    once: in one task of up to ``BIDDERS`` rows, of larger groups in blocks; no task holds more than
    two blocks of vectors, or the lists of one block of bidders and of the owners within their reach.
    """
    save = save or saver(members.sparkSession)
    own = [f"_by{n}" for n in range(len(group))]
    rows = members.select(*[F.col(c).alias(o) for c, o in zip(group, own)], F.col(side).alias("_side"), F.col(v).cast("array<double>").alias("v"))
    rows = save(rows.withColumn("i", F.monotonically_increasing_id()))
    whole = F.col("_side").isNotNull() & usable("v")
    n = lambda s: F.count(F.when(whole & (F.col("_side") == s), 1))
    groups = save(rows.groupBy(*[F.col(o).alias(f"_{o}") for o in own]).agg(F.min("i").alias("g"), n(True).alias("n1"), n(False).alias("n2")))
    points = rows.where(whole).join(groups, [F.col(f"_{o}").eqNullSafe(F.col(o)) for o in own])
    points = points.where("n1 > 0 and n2 > 0").withColumn("bids", F.col("_side") == (F.col("n1") <= F.col("n2")))
    large = F.col("n1") + F.col("n2") > BIDDERS
    points = save(points.select("g", "i", "v", "bids", large.alias("large")))
    sums = _in_one_stream(points.where("not large").drop("large"), gap)
    if not groups.where("n1 > 0 and n2 > 0").where(large).isEmpty():
        sums = sums.unionByName(_in_rounds(points.where("large").drop("large"), gap, save, known))
    out = groups.join(sums, "g", "left")
    return out.select(*[F.col(f"_{o}").alias(c) for c, o in zip(group, own)], F.coalesce("pairs", F.lit(0).cast("long")).alias("pairs"), "similarity", "upper")
