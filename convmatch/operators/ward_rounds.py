"""Ward's clustering of groups of any size, in rounds over all groups at once.

Two clusters that are each other's nearest merge in every hierarchy by Ward's distance, and
merging elsewhere brings nothing nearer to a cluster than its nearest was.  So a round merges all
such pairs of all groups, and only the merged clusters, and those whose nearest one has merged, look
for their nearest again, in blocks.  A group of few clusters is finished by one task; what it
gets are centroids and sizes.  The merges are those of the plain chain.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import usable
from .density import in_blocks
from .tables import saver

_MERGE = "g long, step long, lo long, hi long, h double"


def chain_merges(x: np.ndarray, size: np.ndarray) -> list[tuple[int, int, float]]:
    """(lo, hi, distance) of all merges of clusters with centroids ``x``, by a nearest-neighbour chain."""
    n = len(x)
    centre, size, live = x.astype(float).copy(), size.astype(float).copy(), np.ones(n, dtype=bool)
    merges, chain = [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(live)[0])]
        while True:
            a = chain[-1]
            d = 2 * size[a] * size / (size[a] + size) * ((centre - centre[a]) ** 2).sum(1)
            d[~live] = np.inf
            d[a] = np.inf
            b = int(d.argmin())
            if len(chain) > 1 and d[chain[-2]] <= d[b]:
                b = chain[-2]
            if len(chain) > 1 and b == chain[-2]:
                break
            chain.append(b)
        chain = chain[:-2]
        lo, hi = min(a, b), max(a, b)
        merges.append((lo, hi, float(np.sqrt(d[b]))))
        centre[lo] = (centre[lo] * size[lo] + centre[hi] * size[hi]) / (size[lo] + size[hi])
        size[lo] += size[hi]
        live[hi] = False
    return merges


def _nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """The nearest of ``b`` for each of ``a``, of equals the pair with the least ids, so that
    the order of pairs is the same from either side."""
    none = pd.DataFrame({"g": [], "i": [], "d": [], "lo": [], "hi": []})
    if not len(a) or not len(b):
        return none
    x, y = np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy())
    i, j, n, m = a["i"].to_numpy(), b["i"].to_numpy(), a["n"].to_numpy().astype(float), b["n"].to_numpy().astype(float)
    squares, parts = (y * y).sum(1), []
    scale = squares.max() + (x * x).sum(1).max()
    for at in range(0, len(a), 256):
        xs, ns, own = x[at : at + 256], n[at : at + 256], i[at : at + 256]
        share = 2 * ns[:, None] * m[None] / (ns[:, None] + m[None])
        d = share * np.maximum((xs * xs).sum(1)[:, None] + squares[None] - 2 * xs @ y.T, 0)
        d[own[:, None] == j[None]] = np.inf
        # the products round: all within their error are measured again, from the differences
        row, col = np.nonzero(np.isfinite(d) & (d <= d.min(1)[:, None] * (1 + 1e-9) + share * scale * 1e-13))
        exact = np.empty(len(row))
        step = max(1, 4_000_000 // x.shape[1])
        for s in range(0, len(row), step):
            r, c = row[s : s + step], col[s : s + step]
            exact[s : s + step] = 2 * ns[r] * m[c] / (ns[r] + m[c]) * ((xs[r] - y[c]) ** 2).sum(1)
        lo, hi = np.minimum(own[row], j[col]), np.maximum(own[row], j[col])
        order = np.lexsort((hi, lo, exact, row))
        order = order[np.r_[True, row[order][1:] != row[order][:-1]]] if len(order) else order
        parts.append(pd.DataFrame({"i": own[row[order]], "d": exact[order], "lo": lo[order], "hi": hi[order]}))
    return pd.concat(parts).assign(g=a["g"].iloc[0])[["g", "i", "d", "lo", "hi"]]


def ward_merges(points: DataFrame, save: saver, few: int = 3000) -> DataFrame:
    """(g, step, lo, hi, h): the n - 1 merges of each group of ``points`` (g, i, v), a written table
    with i unique over all groups.

    Cluster ``hi`` goes into ``lo``; a cluster is named by its least point.  Heights never fall
    along the tree, and ``step`` tells which of two merges of one height came first.
    """
    alike = Window.partitionBy("g", "v")
    points = save(points.withColumn("lo", F.min("i").over(alike)))  # rows alike merge first, at height 0
    merges = save(points.where("i > lo").select("g", F.lit(0).cast("long").alias("step"), "lo", F.col("i").alias("hi"), F.lit(0.0).alias("h")))
    live = save(points.groupBy("g", F.col("lo").alias("i")).agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("n"), F.lit(0.0).alias("h")))
    save.drop(points)
    done, near, step = [merges], None, 0
    while True:
        many = save(live.groupBy("g").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > few).select("g"))
        if many.isEmpty():
            break
        step += 1
        at = live.join(many, "g", "left_semi")
        need = at if near is None else at.join(near.select("i"), "i", "left_anti")
        new = in_blocks(need.select("g", "i", "v", "n"), at.select("g", "i", "v", "n"), _nearest, "g long, i long, d double, lo long, hi long")
        new = new.groupBy("g", "i").agg(F.min(F.struct("d", "lo", "hi")).alias("e")).select("g", "i", "e.d", "e.lo", "e.hi")
        near = save(new if near is None else near.join(many, "g", "left_semi").select("g", "i", "d", "lo", "hi").unionByName(new))
        pairs = save(near.groupBy("g", "lo", "hi").agg(F.count(F.lit(1)).alias("_k"), F.first("d").alias("d")).where("_k = 2").select("g", "lo", "hi", "d"))
        if pairs.isEmpty():  # distances that differ by rounding alone: the least pair of each group
            save.drop(pairs)
            pairs = save(near.groupBy("g").agg(F.min(F.struct("d", "lo", "hi")).alias("e")).select("g", "e.lo", "e.hi", "e.d"))
        side = lambda e: live.select(F.col("i").alias(e), F.col("v").alias(f"v_{e}"), F.col("n").alias(f"n_{e}"), F.col("h").alias(f"h_{e}"))
        both = pairs.join(side("lo"), "lo").join(side("hi"), "hi")
        n = F.col("n_lo") + F.col("n_hi")
        mean = F.zip_with("v_lo", "v_hi", lambda p, q: (p * F.col("n_lo") + q * F.col("n_hi")) / n)
        grown = save(both.select("g", "lo", "hi", mean.alias("v"), n.alias("n"), F.greatest(F.sqrt("d"), "h_lo", "h_hi").alias("h")))
        done.append(save(grown.select("g", F.lit(step).cast("long").alias("step"), "lo", "hi", "h")))
        gone = grown.select(F.explode(F.array("lo", "hi")).alias("i"))
        nxt = save(live.join(gone, "i", "left_anti").select("g", "i", "v", "n", "h").unionByName(grown.select("g", F.col("lo").alias("i"), "v", "n", "h")))
        other = F.when(F.col("i") == F.col("lo"), F.col("hi")).otherwise(F.col("lo"))
        kept = near.join(gone, "i", "left_anti").withColumn("_o", other).join(gone.select(F.col("i").alias("_o")), "_o", "left_anti")
        kept = save(kept.select("g", "i", "d", "lo", "hi"))
        save.drop(live, near, pairs, grown, many)
        live, near = nxt, kept

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i", kind="stable")
        ids, h, out = pdf["i"].to_numpy(), pdf["h"].to_numpy().copy(), []
        for k, (lo, hi, d) in enumerate(chain_merges(np.stack(pdf["v"].to_numpy()), pdf["n"].to_numpy())):
            h[lo] = max(d, h[lo], h[hi])
            out.append((pdf["g"].iloc[0], step + 1 + k, ids[lo], ids[hi], h[lo]))
        return pd.DataFrame(out, columns=["g", "step", "lo", "hi", "h"])

    done.append(live.groupBy("g").applyInPandas(finish, _MERGE))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    out = save(out)
    save.drop(live, *done[:-1], *([near] if near is not None else []))
    return out


def cut(points: DataFrame, merges: DataFrame, save: saver, k: DataFrame | None = None, distance: float | None = None) -> DataFrame:
    """(g, i, c): clusters of the points, by their least point, after the merges up to ``distance``,
    or but for the last k - 1; ``k``: (g, k)."""
    if k is not None:
        w = Window.partitionBy("g").orderBy(F.desc("h"), F.desc("step"), F.desc("lo"), F.desc("hi"))
        most = k.agg(F.max("k")).first()[0] or 1
        last = merges.withColumn("_r", F.row_number().over(w)).where(F.col("_r") < most).join(k, "g").where(F.col("_r") < F.col("k"))
        kept = merges.join(last.select("hi"), "hi", "left_anti")
    else:
        kept = merges.where(F.col("h") <= distance)
    up = save(points.select("g", "i").join(kept.select(F.col("hi").alias("i"), F.col("lo").alias("c")), "i", "left").select("g", "i", F.coalesce("c", "i").alias("c")))
    while True:
        above = up.select(F.col("i").alias("c"), F.col("c").alias("_cc"))
        nxt = save(up.join(above, "c").select("g", "i", F.col("_cc").alias("c"), (F.col("_cc") != F.col("c")).alias("moved")))
        same = nxt.where("moved").isEmpty()
        save.drop(up)
        up = nxt
        if same:
            return up.select("g", "i", "c")


def ward_in_rounds(df: DataFrame, by: list[str], key: str, v: str, k: int | None = None, distance: float | None = None, max_items: int | None = None, tries: int = 5, save: saver | None = None, few: int = 3000) -> DataFrame:
    """by, key, label of every row, for groups of any size; the parameters as in
    :func:`~convmatch.operators.cluster.ward_clusters`.

    Labels count from 0 in each group by the clusters' first keys.  All distances within a group
    are computed about once, in blocks.  A row without a vector, or with a component that is null,
    not finite or beyond 1e150, is a cluster of its own, outside the count ``k``.  Rounds are few where many pairs are each other's nearest; points whose gaps
    grow one after the other merge one pair a round.
    """
    save = save or saver(df.sparkSession)
    own = [f"_by{n}" for n in range(len(by))]
    rows = df.select(*[F.col(c).alias(o) for c, o in zip(by, own)], F.col(key).alias("_key"), F.col(v).cast("array<double>").alias("v"))
    rows = save(rows.orderBy(*own, "_key").withColumn("i", F.monotonically_increasing_id()))
    groups = rows.groupBy(*[F.col(o).alias(f"_{o}") for o in own]).agg(F.min("i").alias("g"))
    rows = save(rows.join(groups, [F.col(f"_{o}").eqNullSafe(F.col(o)) for o in own]).select("g", "i", *own, "_key", "v"))
    points = save(rows.where(usable("v")).select("g", "i", "v"))
    merges = ward_merges(points, save, few)
    if max_items is None:
        found = cut(points, merges, save, points.select("g").distinct().withColumn("k", F.lit(k or 1)) if distance is None else None, distance)
    else:
        goal = save(points.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / max_items).alias("k")).withColumn("last", F.lit(None).cast("long")))
        finished = []
        for n in range(tries):
            now = save(cut(points.join(goal, "g", "left_semi"), merges.join(goal, "g", "left_semi"), save, goal.select("g", "k")))
            most = now.groupBy("g", "c").agg(F.count(F.lit(1)).alias("_n")).groupBy("g").agg(F.max("_n").alias("most"))
            state = save(goal.join(most, "g"))
            stop = F.lit(n == tries - 1) | (F.col("most") <= max_items) | (F.coalesce(F.col("most") >= F.col("last"), F.lit(False)) & (F.col("k") > 1))
            finished.append(save(now.join(state.where(stop), "g", "left_semi").select("g", "i", "c")))
            goal = save(state.where(~stop).select("g", (F.col("k") + 1).alias("k"), F.col("most").alias("last")))
            if goal.isEmpty():
                break
        found = finished[0]
        for f in finished[1:]:
            found = found.unionByName(f)
    labelled = save(rows.drop("v").join(found.select("i", "c"), "i", "left").withColumn("c", F.coalesce("c", "i")))
    first = labelled.select("g", "c").distinct().withColumn("label", (F.row_number().over(Window.partitionBy("g").orderBy("c")) - 1).cast("long"))
    return labelled.join(first, ["g", "c"]).select(*[F.col(o).alias(c) for c, o in zip(by, own)], F.col("_key").alias(key), "label")
