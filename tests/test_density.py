"""The density hierarchy against a plain one over all pairs of points."""

from collections import Counter

import numpy as np
import pytest

from convmatch.operators import density
from convmatch.operators.density import density_clusters


def plain(x, least):
    """Labels and strengths top down: components of the graph of all pairs within a falling radius."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, axis=1)[:, min(least, n - 1)] if n > 1 else np.zeros(n)
    w = np.maximum(d, np.maximum(core[:, None], core[None])).astype(np.float32)

    def parts(points, radius):
        points, out = set(points), []
        while points:
            todo, seen = [points.pop()], []
            while todo:
                i = todo.pop()
                seen.append(i)
                more = [j for j in points if w[i, j] < radius]
                points -= set(more)
                todo += more
            out.append(sorted(seen))
        return sorted(out)

    clusters = []  # (points, birth, parent)
    fell = np.zeros(n)
    home = np.zeros(n, dtype=int)

    def descend(points, c):
        while len(points) > 1:
            inside = w[np.ix_(points, points)].copy()
            np.fill_diagonal(inside, 0)
            # the radius at which these points come apart: the largest edge of their tree
            radii = np.unique(inside[inside > 0])
            lo, hi = 0, len(radii) - 1
            while lo < hi:
                mid = (lo + hi) // 2
                if len(parts(points, np.nextafter(radii[mid], np.float32(np.inf)))) == 1:
                    hi = mid
                else:
                    lo = mid + 1
            at = 1 / float(radii[lo])
            split = parts(points, radii[lo])
            big = [s for s in split if len(s) >= least]
            for s in split:
                if len(s) < least:
                    fell[s], home[s] = at, c
            if len(big) > 1:
                for s in big:
                    clusters.append([s, at, c])
                    descend(s, len(clusters) - 1)
            if len(big) != 1:
                return
            points = big[0]

    clusters.append([list(range(n)), 0.0, -1])
    descend(list(range(n)), 0)
    stable = np.zeros(len(clusters))
    for i in range(n):
        stable[home[i]] += fell[i] - clusters[home[i]][1]
    for s, at, c in clusters[1:]:
        stable[c] += len(s) * (at - clusters[c][1])

    def best(c):
        kids = [k for k in range(1, len(clusters)) if clusters[k][2] == c]
        total, picked = 0.0, []
        for k in kids:
            t, p = best(k)
            total, picked = total + t, picked + p
        return (stable[c], [c]) if c and stable[c] >= total else (total, picked)

    label, strength = np.full(n, -1), np.zeros(n)
    for c in best(0)[1]:
        s = clusters[c][0]
        label[s] = c
        strength[s] = fell[s] / max(fell[s])
    return label, strength


def frame(spark, groups):
    return spark.createDataFrame([(g, i, v.tolist()) for g, x in groups.items() for i, v in enumerate(x)], "g string, id long, v array<double>")


def rolling(labels):
    """Labels counted from 0 by their first row."""
    names = {}
    return [names.setdefault(x, len(names)) for x in labels]


def test_equal_to_the_plain_hierarchy(spark, monkeypatch):
    monkeypatch.setattr(density, "BLOCK", 37)
    r = np.random.default_rng(5)
    groups = {
        "blobs": np.concatenate([r.normal(c, s, (n, 2)) for c, s, n in (((0, 0), 0.2, 40), ((4, 4), 0.5, 30), ((0, 9), 0.1, 6), ((0.9, 0.9), 0.1, 12))]),
        "noise": r.uniform(size=(90, 3)),
        "line": np.cumsum(r.exponential(size=(50, 1)), axis=0),
        "rings": np.concatenate([[(np.cos(t) * q, np.sin(t) * q) for t in r.uniform(0, 6.28, 40)] for q in (1, 6)]),
        "few": r.normal(size=(4, 2)),
        "one": r.normal(size=(1, 2)),
        "two": r.normal(size=(2, 2)),
    }
    got = {g: {} for g in groups}
    for x in density_clusters(frame(spark, groups), ["g"], "id", "v").collect():
        got[x["g"]][x["id"]] = (x["label"], x["strength"])
    for g, x in groups.items():
        label, strength = plain(x, 5)
        assert len(got[g]) == len(x)
        if (label < 0).all():
            assert set(got[g].values()) == {(0, 0.0)}
            continue
        mine = [got[g][i][0] for i in range(len(x))]
        inner = np.flatnonzero(label >= 0)
        assert rolling(np.array(mine)[inner]) == rolling(label[inner])
        assert set(mine) == set(np.array(mine)[inner])  # every point is in a cluster
        assert np.allclose([got[g][i][1] for i in inner], strength[inner], rtol=1e-5)
        assert all(0 <= got[g][i][1] <= 1 for i in range(len(x)))


def test_spanning_tree_has_the_least_weight(spark, monkeypatch):
    from convmatch.operators.tables import saver

    monkeypatch.setattr(density, "BLOCK", 50)
    r = np.random.default_rng(6)
    # far apart, so that no neighbour list leads from one heap to another
    x = np.concatenate([r.normal(c, 0.3, (40, 3)) for c in ((0, 0, 0), (50, 0, 0), (0, 90, 0), (0, 0, 200))])
    points = saver(spark)(spark.createDataFrame([(7, i, v.tolist()) for i, v in enumerate(x)], "g long, i long, v array<double>"))
    edges = density.spanning_edges(points, 5, saver(spark)).collect()
    assert len(edges) == len(x) - 1 and all(e["g"] == 7 for e in edges)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, axis=1)[:, 5]
    w = np.maximum(d, np.maximum(core[:, None], core[None])).astype(np.float32)
    inside, total, low = {0}, 0.0, w[0].copy()
    while len(inside) < len(x):
        j = min((j for j in range(len(x)) if j not in inside), key=low.__getitem__)
        total += float(low[j])
        inside.add(j)
        low = np.minimum(low, w[j])
    assert abs(sum(e["w"] for e in edges) - total) < 1e-3


def test_copies_nulls_and_long_series(spark):
    x = np.r_[np.zeros(300), np.ones(300), [0.5] * 3][:, None]
    df = frame(spark, {"g": x}).unionByName(spark.createDataFrame([("g", 10_000, None), ("h", 1, None)], "g string, id long, v array<double>"))
    got = {(r["g"], r["id"]): (r["label"], r["strength"]) for r in density_clusters(df, ["g"], "id", "v").collect()}
    assert len(got) == 605 and got["h", 1] == (0, 0.0)
    assert Counter(got["g", i][0] for i in range(600)) in (Counter({0: 300, 1: 300}), Counter({0: 300, 2: 300}), Counter({1: 300, 2: 300}))
    assert len({got["g", i][0] for i in range(300)}) == 1


@pytest.mark.parametrize("n", [5_000])
def test_a_group_of_more_than_a_block(spark, n):
    r = np.random.default_rng(8)
    centre = r.normal(size=(6, 8)) * 8
    x = centre[np.arange(n) % 6] + r.normal(size=(n, 8)) * 0.5
    got = {r["id"]: r["label"] for r in density_clusters(frame(spark, {"g": x}), ["g"], "id", "v").collect()}
    assert len(got) == n
    pairs = Counter((i % 6, c) for i, c in got.items())
    assert sum(max(m for (a, _), m in pairs.items() if a == t) for t in range(6)) > 0.95 * n
