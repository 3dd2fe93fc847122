"""Change sessions of many series and of long ones."""

import time

import numpy as np
from pyspark.sql import functions as F

from convmatch.operators import series


def test_sessions_of_series_across_batches(spark):
    """Short, long and null-keyed series, in Arrow batches of 7 rows, against one search a series."""
    r = np.random.default_rng(4)
    sizes = {"a": 1, "b": 5, "c": 6, "d": 70, "e": 7, "f": 14, None: 40, "g": 3}
    x = {g: np.repeat(r.normal(size=-(-n // 10)) * 50, 10)[:n] + r.normal(size=n) * 0.1 for g, n in sizes.items()}
    rows = [(g, 1_000 * k + i, i, float(v)) for k, (g, xs) in enumerate(x.items()) for i, v in enumerate(xs)]
    r.shuffle(rows)
    df = spark.createDataFrame([(g, int(e), int(i), float(v)) for g, e, i, v in rows], "g string, id long, at long, x double")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {(y["g"], y["id"]): y["session"] for y in series.change_sessions(df, ["g"], ["at"], ["x"], "id").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want = {(g, 1_000 * k + i): int(np.searchsorted(series.pelt(xs[:, None]), i, side="right")) for k, (g, xs) in enumerate(x.items()) for i in range(len(xs))}
    assert got == want and max(got.values()) >= 3


def test_many_short_series(spark):
    """40,000 series; with a Python call for each these took over a minute."""
    df = spark.range(100_000).select(F.col("id"), (F.col("id") % 40_000).alias("g"), F.rand(3).alias("x"))
    t = time.time()
    out = series.change_sessions(df, ["g"], ["id"], ["x"], "id")
    assert out.agg(F.count(F.lit(1)), F.max("session")).first()[:] == (100_000, 0)
    assert time.time() - t < 25


def test_sessions_of_series_without_rows(spark):
    df = spark.createDataFrame([], "g string, id long, x double")
    assert series.change_sessions(df, ["g"], ["id"], ["x"], "id").collect() == []


def test_sessions_by_gap_and_count_of_many_users(spark, tmp_path):
    """30,000 users of one event, and one whose events slow down and repeat."""
    from convmatch.plans import registry

    at = lambda s: F.timestamp_seconds(F.lit(1704067200) + s)
    many = spark.range(30_000).select(F.col("id").alias("event_id"), at(F.col("id") % 80_000).alias("ts"), F.col("id").alias("user_id"), F.lit("view").alias("event_type"))
    # 20 runs of one event a second apart, then 20 runs of three events 600 seconds apart
    one = [(30_000 + i, i if i < 20 else 20 + 600 * (i - 20), -1, "ab"[i % 2]) for i in range(20)]
    one += [(31_000 + 3 * i + k, 1_000 + 600 * i + k, -1, "ab"[i % 2]) for i in range(20) for k in range(3)]
    few = spark.createDataFrame(one, "event_id long, s long, user_id long, event_type string").select("event_id", at(F.col("s")).alias("ts"), "user_id", "event_type")
    many.unionByName(few).write.parquet(f"{tmp_path}/events.parquet")
    t = time.time()
    out = registry.QUERIES["m5_sessions_by_gap_and_count"](spark, str(tmp_path)).collect()
    assert time.time() - t < 25
    assert len(out) == 30_040 and {r["session"] for r in out if r["user_id"] >= 0} == {0}
    runs = {r["run_id"]: r["session"] for r in out if r["user_id"] < 0}
    assert [runs[i] for i in sorted(runs)] == [0] * 20 + [1] * 20
