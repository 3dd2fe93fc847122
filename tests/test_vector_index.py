"""The kept index and the versions that it lives in."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from convmatch.operators import serving, similarity
from convmatch.operators.vector_index import VectorIndex
from convmatch.operators.versions import Conflict, Snapshot, Versions
from convmatch.plans import registry


def frame(spark, x, ids=None, users=None):
    ids = range(len(x)) if ids is None else ids
    rows = [(int(i), int(i) % 7 if users is None else int(users[n]), v.tolist()) for n, (i, v) in enumerate(zip(ids, x))]
    return spark.createDataFrame(rows, "id long, user long, v array<double>")


def blobs(n, seed, dim=24, centres=60):
    r = np.random.default_rng(seed)
    c = np.random.default_rng(99).normal(size=(centres, dim))
    return c[r.integers(0, centres, n)] + 0.5 * r.normal(size=(n, dim))


def surface(n, seed, dim=24, inner=4):
    """Vectors near a curved surface of ``inner`` dimensions, as embeddings of texts are."""
    fixed = np.random.default_rng(98)
    a, b = fixed.normal(size=(inner, 64)), fixed.normal(size=(64, dim))
    r = np.random.default_rng(seed)
    return np.tanh(r.normal(size=(n, inner)) @ a) @ b + 0.05 * r.normal(size=(n, dim))


def asked(df, every=50):
    return df.where(F.col("id") % every == 0).select(F.col("id").alias("q_id"), F.col("user").alias("q_user"), "v")


def exact(x, ids, q, k, users=None, own=None):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ (q[1] / np.linalg.norm(q[1]))
    order = [j for j in np.lexsort((ids, -s)) if ids[j] != q[0] and (users is None or users[j] != own)]
    return [int(ids[j]) for j in order[:k]]


def recall(found, want):
    return sum(len(set(found.get(q, [])) & set(w)) for q, w in want.items()) / sum(map(len, want.values()))


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["q_id"], r["rank"])):
        out.setdefault(r["q_id"], []).append(r["c_id"])
    return out


def test_recall_and_work_at_ten_times_the_rows(spark, tmp_path):
    work = {}
    for n in (2_000, 20_000):
        x = surface(n, n)
        df = frame(spark, x)
        index = VectorIndex.build(Versions(spark, f"file://{tmp_path}/{n}"), df, k=20)
        q = asked(df, n // 40)
        rows = index.search(q, 20, with_work=True).collect()
        want = {i: exact(x, np.arange(n), (i, x[i]), 20) for i in range(0, n, n // 40)}
        assert recall(by_query(rows), want) >= 0.9
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        assert all(abs(r["score"] - u[r["q_id"]] @ u[r["c_id"]]) < 1e-6 for r in rows)
        met = {r["q_id"]: r["met"] for r in rows}
        work[n] = np.mean(list(met.values()))
        assert work[n] < n / 2
    assert work[20_000] <= 4 * work[2_000]


def test_recall_without_structure(spark, tmp_path):
    for n, x in enumerate((np.random.default_rng(4).normal(size=(3_000, 16)), blobs(3_000, 2))):
        _holds(spark, tmp_path / str(n), x)


def _holds(spark, tmp_path, x):
    df = frame(spark, x)
    index = VectorIndex.build(Versions(spark, f"file://{tmp_path}"), df, k=10)
    want = {i: exact(x, np.arange(3_000), (i, x[i]), 10) for i in range(0, 3_000, 50)}
    assert recall(by_query(index.search(asked(df), 10).collect()), want) >= 0.9


def test_inserts_replacements_and_compaction(spark, tmp_path):
    x = blobs(1_500, 1)
    users = np.arange(1_500) % 5
    versions = Versions(spark, f"file://{tmp_path}")
    VectorIndex.build(versions, frame(spark, x[:1_000], users=users[:1_000]), k=10)
    moved = np.vstack([-x[:100], x[1_000:]])  # 100 come again at the other side, 500 are new
    ids = np.r_[0:100, 1_000:1_500]
    index = VectorIndex.insert(versions, frame(spark, moved, ids, users[ids]), ("w", 0))
    again = VectorIndex.insert(versions, frame(spark, moved, ids, users[ids]), ("w", 0))
    assert again.tables == index.tables and versions.current().version == 2
    now = x.copy()
    now[:100] *= -1
    q = frame(spark, now[::25], np.arange(1_500)[::25], users[::25]).selectExpr("id q_id", "user q_user", "v")
    want = {i: exact(now, np.arange(1_500), (i, now[i]), 10, users, users[i]) for i in range(0, 1_500, 25)}
    got = index.search(q, 10, other_users=True, probes=10**6)
    assert by_query(got.collect()) == want
    old = versions.current()
    whole = VectorIndex.compact(versions)
    assert by_query(whole.search(q, 10, other_users=True, probes=10**6).collect()) == want
    assert whole.live("vectors", "id long, user long, v array<float>, _segment int").count() == 1_500
    assert by_query(VectorIndex.open(old).search(q, 10, other_users=True, probes=10**6).collect()) == want  # pinned


def test_vectors_that_take_no_part(spark, tmp_path):
    good = [(i, 0, [float(i), 1.0, 2.0]) for i in range(30)]
    odd = [(100, 0, None), (101, 0, [0.0, 0.0, 0.0]), (102, 0, [1.0]), (103, 0, [float("nan"), 1.0, 1.0]), (None, 0, [1.0, 1.0, 1.0]), (104, None, [5.0, 1.0, 2.0])]
    df = spark.createDataFrame(good + odd, "id long, user long, v array<double>")
    index = VectorIndex.build(Versions(spark, f"file://{tmp_path}"), df, k=5)
    got = by_query(index.search(df.selectExpr("id q_id", "user q_user", "v"), 40, probes=99).collect())
    ids = {*range(30), 104}
    assert {q: set(c) for q, c in got.items()} == {q: ids - {q} for q in ids - {104}} | ({104: ids - {104}} if 104 in got else {})
    empty = VectorIndex.build(Versions(spark, f"file://{tmp_path}/none"), df.limit(0))
    assert empty.search(df.selectExpr("id q_id", "user q_user", "v"), 3).count() == 0


def test_query_against_exact_neighbours(spark, sf):
    pairs = [{(r["q_id"], r["c_id"]) for r in registry.QUERIES[n](spark, sf).select("q_id", "c_id").collect()} for n in ("v6_nearest", "v7_index_nearest")]
    assert len(pairs[0] & pairs[1]) >= 0.9 * len(pairs[0]) and len(pairs[0]) == len(pairs[1])


# -- versions


def test_readers_during_swaps_see_one_version(spark, tmp_path):
    root = f"file://{tmp_path}"
    frames = [spark.createDataFrame([(i,)], "x int") for i in range(5)]
    serving.swap_tables({"a": frames[0], "b": frames[0]}, root)
    seen, wrong, stop = [], [], threading.Event()

    def read():
        while not stop.is_set():
            try:
                s = Versions(spark, root).current()
                seen.append(tuple(s.table(n).first()[0] for n in "ab"))
            except Exception as e:  # noqa: PERF203
                wrong.append(e)

    t = threading.Thread(target=read)
    t.start()
    for f in frames[1:]:
        serving.swap_tables({"a": f, "b": f}, root)
    stop.set()
    t.join()
    assert not wrong and seen and all(a == b for a, b in seen)
    assert [serving.current_table(spark, root, n).first()[0] for n in "ab"] == [4, 4]


def test_lost_and_late_writers(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}")
    one, two = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2,)], "x int")
    base = v.publish(v.current(), {"t": [v.stage("t", one)]}, ("w", 4), {"m": 1})
    with pytest.raises(Exception):  # lost while it wrote its second table
        serving.swap_tables({"t": two, "u": two.select(F.raise_error(F.lit("lost")).alias("x"))}, v.root)
    assert v.current() == base and v.current().table("t").first()[0] == 1
    new = v.publish(base, {"u": [v.stage("u", two)]}, ("z", 1))
    with pytest.raises(Conflict):
        v.publish(base, {"t": [v.stage("t", two)]})
    assert new.tables.keys() == {"t", "u"} and new.commits == {"w": 4, "z": 1} and new.meta == {"m": 1}
    assert v.current() == new and v.at(1).table("t").first()[0] == 1
    v.update(lambda b: {"tables": {"t": [v.stage("t", two)]}})
    gone = v.vacuum(keep=1)
    assert gone == base.tables["t"] and v.current().table("u").first()[0] == 2
    assert Snapshot(spark).table("none", "x int").count() == 0


def test_writers_side_by_side_lose_nothing(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}")
    paths = {i: v.stage(f"t{i}", spark.range(i)) for i in range(6)}
    threads = [threading.Thread(target=lambda i=i: Versions(spark, v.root).update(lambda b: {"tables": {f"t{i}": [paths[i]]}})) for i in paths]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert v.current().tables.keys() == {f"t{i}" for i in paths} and v.current().version == 6
