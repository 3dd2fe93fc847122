"""Density clusters of many groups in one stream, against the plain hierarchy and the rounds."""

import time

import numpy as np
from pyspark.sql import functions as F

from convmatch.operators import cluster, density
from convmatch.operators.density import density_clusters

from .test_density import frame, plain, rolling


def _groups():
    r = np.random.default_rng(15)
    heaps = lambda *parts: np.concatenate([r.normal(c, s, (n, 2)) for c, s, n in parts])
    out = {"blobs": heaps(((0, 0), 0.2, 40), ((4, 4), 0.5, 30), ((0, 9), 0.1, 6)), "noise": r.uniform(size=(90, 3)), "ties": r.integers(0, 4, (60, 2)).astype(float)}
    out |= {f"n{n}": heaps(((0, 0), 0.1, n - n // 2), ((9, 9), 0.1, n // 2)) for n in range(2, 13)}
    return out | {"copies": np.r_[np.zeros(9), np.ones(7), 0.5][:, None], "wide": r.normal(size=(25, 40)) + 9 * (np.arange(25) % 2)[:, None]}


def _got(df):
    return {(x["g"], x["id"]): (x["label"], x["strength"]) for x in density_clusters(df, ["g"], "id", "v").collect()}


def test_equal_to_plain_hierarchy_and_rounds(spark, monkeypatch):
    groups = _groups()
    more = spark.createDataFrame([("blobs", -1, None), ("blobs", 10_000, [float("nan"), 0.0]), ("blobs", 10_001, [1.0, None]), (None, 5, [1.0, 1.0])], "g string, id long, v array<double>")
    df = frame(spark, groups).unionByName(more)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 13)
    try:
        got = _got(df)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    monkeypatch.setattr(density, "BLOCK", 60)  # groups of over 30 rows go in rounds
    mixed = _got(df)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in mixed.items()}
    assert all(np.isclose(got[k][1], mixed[k][1], rtol=1e-12) for k in got)
    assert len(got) == sum(map(len, groups.values())) + 4 and got[None, 5] == (0, 0.0)
    assert got["blobs", -1] == got["blobs", 10_000] == got["blobs", 10_001] == (0, 0.0)
    for g, x in groups.items():
        if len(np.unique(x, axis=0)) < len(x):  # the plain one knows no copies
            continue
        label, strength = plain(x, 5)
        mine = [got[g, i] for i in range(len(x))]
        if (label < 0).all():
            assert set(mine) == {(0, 0.0)}, g
            continue
        inner = np.flatnonzero(label >= 0)
        assert rolling([mine[i][0] for i in inner]) == rolling(label[inner]), g
        assert np.allclose([mine[i][1] for i in inner], strength[inner], rtol=1e-5), g


def test_many_small_groups(spark):
    """20,000 series of messages; with a Python call for each these took over a minute."""
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("id") % 86_400)
    df = spark.range(60_000).select("id", (F.col("id") % 20_000).alias("g"), at.alias("ts"), F.concat(F.lit("text "), F.col("id")).alias("t"))
    start = time.time()
    out = cluster.message_clusters(df, ["g"], "id", "ts", "t")
    assert out.agg(F.count(F.lit(1)), F.max("label"), F.max("strength")).first()[:] == (60_000, 0, 0.0)
    assert time.time() - start < 30
