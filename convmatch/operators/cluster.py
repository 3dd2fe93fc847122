"""Dimension reduction and clustering of match groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .density import density_clusters
from .tables import saver
from .ward_rounds import chain_merges, ward_in_rounds


def reduce_dimensions(df: DataFrame, v: str, k: int = 100) -> tuple[DataFrame, list[float]]:
    """PCA to min(k, dim, n - 2) components, one fit for all rows; and the variance shares."""
    n, dim = df.count(), df.select(F.max(F.size(v))).first()[0] or 0
    k = max(1, min(k, dim, n - 2))
    data = df.withColumn("_v", array_to_vector(v))
    model = PCA(k=k, inputCol="_v", outputCol="_r").fit(data)
    out = model.transform(data).withColumn("reduced", vector_to_array("_r")).drop("_v", "_r")
    return out, [float(x) for x in model.explainedVariance]


def explained_variance(shares: list[float], counts: tuple[int, ...] = (2, 3, 10, 50, 100)) -> list[tuple[int, float]]:
    return [(c, float(np.sum(shares[:c]))) for c in counts if c <= len(shares)]


def ward(x: np.ndarray, k: int | None = None, distance: float | None = None) -> np.ndarray:
    """Agglomerative labels by Ward's criterion, nearest-neighbour chain; 0-based by first row."""
    n = len(x)
    if n == 0:
        return np.empty(0, dtype=int)
    merges = sorted(((h, lo, hi) for lo, hi, h in chain_merges(x, np.ones(n))), key=lambda m: m[0])
    take = [m for m in merges if m[0] <= distance] if distance is not None else merges[: n - min(k or 1, n)]
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for _, a, b in take:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return np.unique([find(i) for i in range(n)], return_inverse=True)[1]


def ward_clusters(df: DataFrame, by: list[str], key: str, v: str, k: int | None = None, distance: float | None = None, max_items: int | None = None, tries: int = 5) -> DataFrame:
    """by, key, label.  With ``max_items`` starts at ceil(n / max_items) clusters and adds one
    until the largest fits, no try helps or ``tries`` are over.  A group of up to ``ONE_TASK``
    rows is one task; larger ones go in rounds (:func:`~convmatch.operators.ward_rounds.ward_in_rounds`)."""
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable")
        x = np.stack(pdf[v].to_numpy())
        if max_items is None:
            label = ward(x, k, distance)
        else:
            c, last = -(-len(x) // max_items), None
            for _ in range(tries):
                label = ward(x, c)
                most = np.bincount(label).max()
                if most <= max_items or (last is not None and most >= last and c > 1):
                    break
                last, c = most, c + 1
        return pdf[[*by, key]].assign(label=label.astype("int64"))

    save = saver(df.sparkSession)
    rows = save(df.select(*by, key, v))
    sizes = rows.groupBy(*[F.col(c).alias(f"_{n}_of_group") for n, c in enumerate(by)]).agg(F.count(F.lit(1)).alias("_size"))
    large = save(sizes.where(F.col("_size") > ONE_TASK).drop("_size"))
    same = [F.col(f"_{n}_of_group").eqNullSafe(F.col(c)) for n, c in enumerate(by)]
    some = not large.isEmpty()
    small = rows.join(large, same, "left_anti") if some else rows
    out = small.groupBy(*by).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in [*by, key]) + ", label long")
    if some:
        out = out.unionByName(ward_in_rounds(rows.join(large, same, "left_semi"), by, key, v, k, distance, max_items, tries, save, ONE_TASK))
    return out


#: Conversations of a user that take part in matching: the newest (fixed value).
NEWEST = 1500

#: Rows of a group that one task clusters: two users' newest.
ONE_TASK = 2 * NEWEST


def match_members(top: DataFrame, vectors: DataFrame, newest: int = NEWEST, order: str = "conversation_id") -> DataFrame:
    """Rows of both users of every match: current_user_id, match_group_id and the vectors of
    each user's ``newest`` conversations, by ``order``."""
    w = Window.partitionBy("user_id").orderBy(F.desc(order))
    vectors = vectors.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= newest).drop("_n")
    both = top.select(F.col("user_id").alias("current_user_id"), "match_group_id", F.explode(F.array("user_id", "other_id")).alias("user_id"))
    return both.join(vectors, "user_id")


def number_clusters(members: DataFrame, label: str = "label") -> DataFrame:
    """Cluster ids over all match groups of a user, without gaps."""
    ids = members.select("current_user_id", "match_group_id", label).distinct()
    w = Window.partitionBy("current_user_id").orderBy("match_group_id", label)
    return members.join(ids.withColumn("cluster_id", F.row_number().over(w) - 1), ["current_user_id", "match_group_id", label])


def representatives(df: DataFrame, limit: int = 300) -> DataFrame:
    """All rows of users with up to ``limit``; of others each cluster's row nearest to its
    centroid (cosine).  ``df``: user_id, label, conversation_id, v."""
    from ..functions.vectors import centroid, cosine

    w = Window.partitionBy("user_id")
    counted = df.withColumn("_c", F.count(F.lit(1)).over(w))
    large = counted.where(F.col("_c") > limit)
    near = large.join(centroid(large, ["user_id", "label"]), ["user_id", "label"]).withColumn("_s", cosine("v", "centroid"))
    pick = Window.partitionBy("user_id", "label").orderBy(F.desc(F.round("_s", 9)), "conversation_id")
    best = near.withColumn("_n", F.row_number().over(pick)).where("_n = 1")
    return counted.where(F.col("_c") <= limit).select(*df.columns).unionByName(best.select(*df.columns))


def cluster_heads(members: DataFrame, by: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Values of the first member of each cluster, such as its category and start."""
    return members.groupBy(*by).agg(F.min(F.struct(*order, *[c for c in values if c not in order])).alias("_f")).select(*by, *[F.col("_f").getField(c).alias(c) for c in values])


def membership(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """Cluster members of both users with their vectors joined back, sorted by cluster."""
    rows = members.select("current_user_id", "match_group_id", "cluster_id", "user_id", "conversation_id")
    return rows.join(vectors.select("user_id", "conversation_id", F.col("v").alias("embedding")), ["user_id", "conversation_id"], "left").orderBy("current_user_id", "cluster_id", "user_id", "conversation_id")


def message_clusters(messages: DataFrame, by: list[str], key: str, ts: str, text: str, least: int = 5, save: saver | None = None) -> DataFrame:
    """Density clusters of messages on (time, compression ratio), each scaled to unit deviation
    within its series, which may be of any length."""
    from ..functions.text import compression_ratio

    w = Window.partitionBy(*by)
    d = messages.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).withColumn("_r", F.coalesce(compression_ratio(F.col(text)), F.lit(0.0)))
    unit = lambda c: F.coalesce((F.col(c) - F.avg(c).over(w)) / F.nullif(F.stddev_pop(c).over(w), F.lit(0.0)), F.lit(0.0))
    d = d.withColumn("_v", F.array(unit("_t"), unit("_r")))
    return density_clusters(d, by, key, "_v", least, save)
