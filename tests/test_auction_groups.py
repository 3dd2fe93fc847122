"""Matching of many groups in one stream, beside those that go in rounds."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from convmatch.operators import auction
from convmatch.operators.similarity import optimal_matching

from .test_auction import _held, _table, _unit


@pytest.mark.parametrize("n, m", [(1, 1), (1, 7), (5, 5), (40, 41), (60, 200)])
def test_whole_groups_are_within_the_gap(n, m):
    r = np.random.default_rng(n + m)
    for s in (r.uniform(-1, 1, (n, m)), r.uniform(-1, 1, (n, m)).round(1), np.ones((n, m)), r.uniform(size=(n, m)) - 5):
        got, upper = auction.play_whole(s, 0.01)
        want = optimal_matching(s)
        assert got - 1e-9 <= want <= upper + 1e-9 and upper - got <= 0.01 + 1e-9


@pytest.mark.parametrize("rounds", [0, 1, 5, 40])
@pytest.mark.parametrize("n, m", [(1, 1), (1, 6), (30, 30), (25, 60)])
def test_shortest_paths_end_the_matching(monkeypatch, rounds, n, m):
    monkeypatch.setattr(auction, "ROUNDS", rounds)
    r = np.random.default_rng(rounds + n)
    for s in (r.uniform(-1, 1, (n, m)), r.uniform(-1, 1, (n, m)).round(1), np.ones((n, m)), np.tile(r.uniform(size=m), (n, 1)), 3e15 * r.uniform(size=(n, m))):
        got, upper = auction.play_whole(s, 0.01)
        want, tiny = optimal_matching(s), 1e-9 * max(1.0, np.abs(s).max())
        assert got - tiny <= want <= upper + tiny and upper - got <= 0.01 + tiny


def test_many_bidders_for_few_copies():
    """300 equal bidders for 100 of their kind: prices rise by the gap for long."""
    r = np.random.default_rng(2)
    a, b = (np.r_[np.repeat(np.eye(1, 32), k, 0), _unit(r, 400 - k, 32)] for k in (300, 100))
    t = time.time()
    got, upper = auction.play_whole(a @ b.T, 1e-4)
    assert 0 <= upper - got <= 1e-4 and time.time() - t < 15


def test_groups_in_one_stream_and_in_rounds(spark, monkeypatch):
    """Groups of over 70 rows in rounds, the others whole, in Arrow batches of 11 rows."""
    monkeypatch.setattr(auction, "BIDDERS", 70)
    r = np.random.default_rng(8)
    near = _unit(r, 1, 6) + 0.05 * r.normal(size=(60, 6))
    groups = {
        "equal": (_unit(r, 45, 6), _unit(r, 45, 6)), "more objects": (_unit(r, 20, 6), _unit(r, 51, 6)), "just whole": (_unit(r, 35, 6), _unit(r, 35, 6)),
        "more bidders": (_unit(r, 31, 6), _unit(r, 9, 6)), "crowd": (near[:28], near[28:]), "one": (_unit(r, 1, 6), _unit(r, 1, 6)), "none": (np.empty((0, 6)), _unit(r, 80, 6)),
        "copies": ([[0.6, 0.8]] * 20, [[0.6, 0.8]] * 17 + [[0.0, 1.0]] * 9),
    }
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 11)
    try:
        _held(spark, groups, gap=0.01)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_many_groups(spark):
    """2,000 small groups and 10 of 300 rows; in rounds, these took minutes."""
    r = np.random.default_rng(9)
    large = _table(spark, {f"l{g}": (_unit(r, 150, 16), _unit(r, 150, 16)) for g in range(10)})
    v = F.array(*[F.rand(n) for n in range(4)])
    small = spark.range(14_000).select((F.col("id") % 2_000).cast("string").alias("g"), (F.col("id") < 6_000).alias("side"), v.alias("v"))
    t = time.time()
    out = auction.auction_matching(small.unionByName(large), ["g"], "side", gap=0.005).collect()
    assert time.time() - t < 30
    assert len(out) == 2_010 and sum(x["pairs"] for x in out) == 2_000 * 3 + 10 * 150
    assert all(-1e-9 <= x["upper"] - x["similarity"] <= 0.005 + 1e-9 for x in out)
