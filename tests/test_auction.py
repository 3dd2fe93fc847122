"""Matching by auction against the exact one."""

import numpy as np
import pytest

from convmatch.operators import auction
from convmatch.operators.auction import auction_matching
from convmatch.operators.similarity import optimal_matching


def _table(spark, groups):
    rows = [(g, side, [float(z) for z in x]) for g, (a, b) in groups.items() for side, part in ((True, a), (False, b)) for x in part]
    return spark.createDataFrame(rows, "g string, side boolean, v array<double>")


def _unit(r, n, d):
    x = r.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _held(spark, groups, gap=1e-3, **more):
    got = {x["g"]: x for x in auction_matching(_table(spark, groups), ["g"], "side", gap=gap, **more).collect()}
    assert set(got) == set(groups)
    for g, (a, b) in groups.items():
        x = got[g]
        assert x["pairs"] == min(len(a), len(b))
        if not len(a) or not len(b):
            assert x["similarity"] is None and x["upper"] is None
            continue
        want = optimal_matching(np.asarray(a) @ np.asarray(b).T)
        assert x["similarity"] - 1e-9 <= want <= x["upper"] + 1e-9, g
        assert x["upper"] - x["similarity"] <= gap + 1e-9, g


def test_within_the_gap_of_the_best(spark):
    r = np.random.default_rng(3)
    near = _unit(r, 1, 6) + 0.05 * r.normal(size=(60, 6))
    _held(spark, {
        "equal": (_unit(r, 80, 6), _unit(r, 80, 6)), "more objects": (_unit(r, 20, 6), _unit(r, 90, 6)), "more bidders": (_unit(r, 90, 6), _unit(r, 31, 6)),
        "one": (_unit(r, 1, 6), _unit(r, 1, 6)), "crowd": (near[:35], near[35:]), "none": (_unit(r, 3, 6), np.empty((0, 6))),
    })


def test_repeated_rows_nulls_and_no_rows(spark):
    one = [0.6, 0.8]
    _held(spark, {"copies": ([one] * 70, [one] * 65 + [[0.0, 1.0]] * 9)})
    rows = [(None, True, [1.0, 0.0]), (None, False, [0.5, 0.5]), (None, False, None), (None, None, [9.0, 9.0]), (None, False, [float("nan"), 1.0]), (None, True, [1e200, 1.0]), (None, True, [1.0, None])]
    df = spark.createDataFrame(rows, "g string, side boolean, v array<double>")
    assert [(x["g"], x["pairs"], x["similarity"]) for x in auction_matching(df, ["g"], "side").collect()] == [(None, 1, 0.5)]
    assert auction_matching(df.limit(0), ["g"], "side").collect() == []


def test_many_blocks_and_widened_lists(spark, monkeypatch):
    """Blocks of 24 bidders that know 5 objects each, all of which want the same few."""
    monkeypatch.setattr(auction, "BIDDERS", 24)
    r = np.random.default_rng(5)
    liked = _unit(r, 1, 5) * np.linspace(1.0, 0.6, 48)[:, None] + 0.02 * r.normal(size=(48, 5))
    _held(spark, {"a": (np.abs(_unit(r, 40, 5)), np.abs(liked))}, gap=0.02, known=5)


@pytest.mark.parametrize("seed", range(20))
def test_play_keeps_everyone_within_the_gap(seed):
    r = np.random.default_rng(seed)
    n, m = r.integers(1, 9), 9
    s = r.random((n, m)).round(1)
    price, owner, asks = auction.play(np.tile(np.arange(m), (n, 1)), s, np.full(n, -np.inf), np.zeros(m), np.full(m, -1), 0.01)
    got = sum(s[o, j] for j, o in enumerate(owner) if o >= 0)
    assert not asks.any() and (price[owner < 0] == 0).all()
    assert optimal_matching(s) * n - got <= n * 0.01 + 1e-9


def test_play_ends_on_large_worth():
    s = np.array([[3e17, 1e17], [3e17, 2e17]])
    _, owner, _ = auction.play(np.tile(np.arange(2), (2, 1)), s, np.full(2, -np.inf), np.zeros(2), np.full(2, -1), 1e-3)
    assert owner.tolist() == [0, 1]
