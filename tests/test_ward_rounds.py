"""Ward merges in rounds against the plain chain of one task."""

import numpy as np

from convmatch.operators import cluster, density
from convmatch.operators.tables import saver
from convmatch.operators.ward_rounds import ward_in_rounds, ward_merges


def _points(seed, n, d=4):
    r = np.random.default_rng(seed)
    return (r.normal(size=(12, d)) * 4)[r.integers(0, 12, n)] + r.normal(size=(n, d)) * r.uniform(0.1, 1.5, size=(n, 1))


def _table(spark, groups):
    return spark.createDataFrame([(g, i, [float(z) for z in x]) for g, p in groups.items() for i, x in enumerate(p)], "g string, id long, v array<double>")


def _labels(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["g"], {})[r["id"]] = r["label"]
    return {g: [x[i] for i in sorted(x)] for g, x in out.items()}


def test_same_labels_as_the_chain_in_many_rounds_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(density, "BLOCK", 50)
    groups = {"a": _points(1, 160), "b": _points(2, 90), "one": _points(3, 1)}
    df = _table(spark, groups)
    got = _labels(ward_in_rounds(df, ["g"], "id", "v", k=6, few=20))
    assert {g: list(cluster.ward(p, 6)) for g, p in groups.items()} == got


def test_merges_have_the_heights_of_the_chain(spark):
    x = np.round(_points(7, 70, 2), 1)
    x[40:50] = x[3]  # rows alike
    points = spark.createDataFrame([(0, i, [float(z) for z in p]) for i, p in enumerate(x)], "g long, i long, v array<double>")
    rows = ward_merges(saver(spark)(points), saver(spark), few=10).collect()
    plain = np.sort([m[2] for m in cluster.chain_merges(x, np.ones(len(x)))])
    assert len(rows) == 69 and len({r["hi"] for r in rows}) == 69
    assert np.allclose(np.sort([r["h"] for r in rows])[:15], plain[:15])
    assert abs(np.sum([r["h"] ** 2 for r in rows]) - np.sum(plain**2)) < 1e-6 * np.sum(plain**2)


def test_caps_distance_nulls_and_no_rows(spark):
    p = _points(4, 120)
    df = _table(spark, {"a": p})
    plain = cluster.ward_clusters(df, ["g"], "id", "v", max_items=25)
    assert _labels(ward_in_rounds(df, ["g"], "id", "v", max_items=25, few=30)) == _labels(plain)
    assert _labels(ward_in_rounds(df, ["g"], "id", "v", distance=3.0, few=30))["a"] == list(cluster.ward(p, distance=3.0))
    odd = spark.createDataFrame([(None, 1, [0.0]), (None, 2, None), (None, 3, [0.0]), (None, 4, [float("inf")])], "g string, id long, v array<double>")
    assert sorted((r["id"], r["label"]) for r in ward_in_rounds(odd, ["g"], "id", "v", k=1).collect()) == [(1, 0), (2, 1), (3, 0), (4, 2)]
    assert ward_in_rounds(odd.limit(0), ["g"], "id", "v", k=2).collect() == []


def test_large_groups_go_through_rounds(spark, monkeypatch):
    """``ward_clusters`` has no bound on groups: those beyond one task's share go in rounds."""
    monkeypatch.setattr(cluster, "ONE_TASK", 60)
    groups = {"large": _points(5, 100), "small": _points(6, 40)}
    got = _labels(cluster.ward_clusters(_table(spark, groups), ["g"], "id", "v", k=4))
    assert {g: list(cluster.ward(p, 4)) for g, p in groups.items()} == got
