"""Unit and property tests of the library's own operators."""

import json
import os
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from convmatch.functions import periods, text
from convmatch.operators import assemble, balance, cluster, graph, match_run, paths, scoring, serving, series, similarity
from convmatch.plans import registry
from convmatch.sources import exports
from convmatch.streaming import live, snapshots

from .compare import differs, duck


EMPTY_ON_SMALL_TABLES = {"s7_partition_diff"}


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, sf, name):
    why = differs(spark, duck(sf), registry.QUERIES[name], registry.ORACLE_SQL[name], sf)
    # these list what is wrong in the tables, and on the smallest ones nothing is
    assert why is None or (why == "no rows" and name in EMPTY_ON_SMALL_TABLES)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_lsh_recall(spark, sf):
    want, got = ({(r["q_id"], r["c_id"]) for r in registry.QUERIES[n](spark, sf).select("q_id", "c_id").collect()} for n in ("v6_nearest", "v7_lsh_nearest"))
    assert len(want & got) >= 0.9 * len(want)
    x = np.random.default_rng(3).normal(size=(40, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    q, c = df.where("id < 5").selectExpr("id as q_id", "0L as q_user", "v"), df.selectExpr("id as c_id", "0L as c_user", "v")
    got = {(r["q_id"], r["rank"]): r["c_id"] for r in similarity.bucket_nearest(q, c, 30, bucket=1e-9).collect()}  # no bucket is shared
    for i in range(5):
        order = [j for j in np.argsort(((x - x[i]) ** 2).sum(1)) if j != i]
        assert [got[i, n + 1] for n in range(30)] == order[:30]


def test_candidate_users_against_all_pairs(spark, sf):
    """Users with interests of their own: the most similar ones are found through the lists."""
    r = np.random.default_rng(21)
    centre = r.normal(size=(40, 16))
    rows = []
    for u in range(60):
        likes = r.choice(40, 4, replace=False)
        for i in range(30):
            x = centre[likes[i % 4]] + 0.4 * r.normal(size=16)
            rows.append((u, u * 1000 + i, (x / np.linalg.norm(x)).tolist()))
    v = spark.createDataFrame(rows, "user_id long, conversation_id long, v array<double>")
    want = {(x["user_id"], x["other_id"]): x["similarity"] for x in similarity.top_users(similarity.user_similarity(v)).collect()}
    got = {(x["user_id"], x["other_id"]): x["similarity"] for x in similarity.candidate_top_users(v, candidates=15, probes=4).collect()}
    assert len(want.keys() & got.keys()) >= 0.9 * len(want) and len(got) == len(want)
    assert all(abs(want[p] - got[p]) < 1e-9 for p in want.keys() & got.keys())


def test_match_run_from_vectors_to_serving_rows(spark, tmp_path):
    """Three users with two interests each; every step's result is held against its meaning."""
    r = np.random.default_rng(31)
    rows = []
    for u in range(3):
        for i in range(24):
            x = np.eye(6)[i % 2 + u // 2 * 2] + 0.1 * r.normal(size=6)
            rows.append((u, 100 * u + i, (x / np.linalg.norm(x)).tolist()))
    v = spark.createDataFrame(rows, "user_id long, conversation_id long, v array<double>")
    talks = v.selectExpr("user_id", "conversation_id", "cast(null as string) title", "concat('talk ', conversation_id) summary", "'2024-01-01' date_text")
    none = spark.createDataFrame([], "user_id long, conversation_id long, questions array<string>")
    asked = []

    def categorise(prompts):
        asked.extend(prompts)
        return ['{"category": "Research"}'] * len(prompts)

    out = match_run.match_run(v, talks, none, categorise, scoring.first_ids_path, paths.saver(spark, f"file://{tmp_path}"), k=2, total=2)
    assert {(x["u1"], x["u2"]) for x in out["matches"].collect()} == {(0, 1), (0, 2), (1, 2)}
    found = out["paths"].collect()
    assert found and all(x["category"] == "research" and x["valid"] for x in found)
    for x in found:
        me, other = x["current_user_id"], x["other_user_id"]
        assert other != me and all(c // 100 == me for c in x["user1"]) and all(c // 100 == other for c in x["user2"])
        assert {c // 100 for c in x["common"]} == {me, other}
    for me in range(3):
        for g in range(2):
            ids = [c for x in found if (x["current_user_id"], x["match_group_id"]) == (me, g) for c in (*x["common"], *x["user1"], *x["user2"])]
            assert len(ids) == len(set(ids))
    assert out["user_paths"].count() == 2 * len(found)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


TREE = {
    "id": "c1", "conversation_id": "c1", "title": "", "mapping": {
        "u": {"id": "u", "children": ["a1", "a2", "gone"], "message": {"author": {"role": "user"}, "create_time": 1700000000.0, "content": {"parts": ["Hello", "mail me@x.org"]}}},
        "a1": {"id": "a1", "children": [], "message": {"author": {"role": "assistant"}, "create_time": 1.0, "content": {"parts": ["old"]}}},
        "a2": {"id": "a2", "children": [], "message": {"author": {"role": "assistant"}, "create_time": 2.0, "content": {"parts": ["new"]}}},
        "s": {"id": "s", "children": [], "message": {"author": {"role": "system"}, "create_time": 3.0, "content": {"parts": ["x"]}}},
        "z": {"id": "z", "children": [], "message": {"author": {"role": "user"}, "create_time": 0.0, "content": {"parts": ["no time"]}}},
        "t": {"id": "t", "children": ["b1", "b2"], "message": {"author": {"role": "user"}, "create_time": 1700000100.5, "content": {"parts": ["tie"]}}},
        "b1": {"id": "b1", "children": [], "message": {"author": {"role": "assistant"}, "create_time": None, "content": {"parts": ["first"]}}},
        "b2": {"id": "b2", "children": [], "message": {"author": {"role": "assistant"}, "create_time": 0.0, "content": {"parts": ["second"]}}},
        "e": {"id": "e", "children": [], "message": {"author": {"role": "user"}, "create_time": 1700000200.0, "content": {"parts": ["no answer"]}}},
    },
}
LIST = {"uuid": "l1", "name": "list", "chat_messages": [{"sender": s, "text": x, "created_at": f"2024-01-0{i + 1}T10:00:00Z", "content": []} for i, (s, x) in enumerate([("human", "q1"), ("assistant", "a1"), ("human", "q2"), ("human", "q3"), ("assistant", "a3"), ("assistant", "a4")])]}


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    root = tmp_path_factory.mktemp("api")
    for user, provider, data in (("u1", "openai", [TREE]), ("u2", "anthropic", [LIST]), ("u3", "openai", [{"title": "odd"}]), ("u4", "anthropic", [{"uuid": "x", "chat_messages": []}])):
        d = root / user / provider
        d.mkdir(parents=True)
        (d / "latest.json").write_text(json.dumps(data))
    return f"{root}/*/*/latest.json"


def test_exports(spark, archive):
    convs = exports.read_exports(spark, archive)
    assert {(r["user_id"], r["provider"], r["shape"]) for r in convs.collect()} == {("u1", "openai", "tree"), ("u2", "anthropic", "list"), ("u3", "openai", "unknown"), ("u4", "anthropic", "list")}
    good, rejects = exports.exchanges(convs)
    rows = {(r["user_id"], r["question"]): r for r in good.collect()}
    assert rows["u1", "Hello\nmail me@x.org"]["answer"] == "new" and rows["u1", "Hello\nmail me@x.org"]["title"] is None
    assert rows["u1", "tie"]["answer"] == "first" and rows["u1", "no answer"]["answer"] is None
    assert {q for u, q in rows if u == "u2"} == {"q1", "q3"} and len(rows) == 5
    assert {(r["user_id"], r["reason"]) for r in rejects.collect()} == {("u3", "no exchange"), ("u3", "unknown shape"), ("u4", "no exchange")}
    hidden, _ = exports.exchanges(exports.redact_exports(convs))
    assert "Hello\nmail [redacted email]" in {r["question"] for r in hidden.collect()}


def test_tables_by_user(spark, tmp_path):
    path = str(tmp_path / "t")
    exports.write_by_user(spark.createDataFrame([(1, "a"), (2, "b")], "user_id int, x string"), path)
    exports.write_by_user(spark.createDataFrame([(2, "c")], "user_id int, x string"), path)
    assert {(r["user_id"], r["x"]) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "c")}
    assert exports.read_user(spark, path, 2).first()["x"] == "c"


def test_redaction(spark):
    secret = "aB3dE5fG7hI9jK1lM2nO4pQ6rS8tU0vWxYz"
    df = spark.createDataFrame([("éfoo@x.com  tel 555-123-4567",), (f"key  {secret}  end",), ("two  blanks",), (None,)], "t string")
    got = [r[0] for r in df.select(text.redact(F.col("t"))).collect()]
    assert got == ["é[redacted email]  tel [redacted phone]", "key [redacted high entropy] end", "two  blanks", None]


def test_word_entropy(spark, tmp_path):
    rows = [(1, "x" * 60 + " abcd\n aab  été"), (2, ""), (3, " \t"), (4, None), (5, " ".join(f"w{i}" for i in range(300)))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def bits(w):
        return -sum(w.count(c) / len(w) * np.log2(w.count(c) / len(w)) for c in set(w))

    got = {r["doc_id"]: r["bits"] for r in registry.QUERIES["r3_word_entropy"](spark, str(tmp_path)).collect()}
    assert got[4] is None
    for i, t in rows:
        if t is not None:
            assert len(got[i]) == len(t.split()) and np.allclose(got[i], [bits(w) for w in t.split()], atol=1e-6)
    words = spark.createDataFrame([(w,) for w in rows[0][1].split()], "w string")
    assert np.allclose(got[1], [r[0] for r in words.select(text.entropy(F.col("w"))).collect()], atol=1e-6)


def test_all_rows_of_hours_and_sides(spark, tmp_path):
    times = ["2024-01-01 00:10:00", "2024-01-01 00:20:00", "2024-01-01 03:00:00"]
    spark.createDataFrame([(i + 1, "view", x) for i, x in enumerate(times)], "event_id long, event_type string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(map(tuple, registry.QUERIES["m3_all_hourly_filled"](spark, str(tmp_path)).collect()))
    assert got == [("2024-01-01 00", 2), ("2024-01-01 01", 0), ("2024-01-01 02", 0), ("2024-01-01 03", 1)]
    rows = spark.createDataFrame([(1, i, None, None, f"s{i}") for i in (7, 0, 5)], "g int, row_idx long, title string, date_text string, summary string")
    block = paths.side_text(rows, ["g"], ["row_idx"]).first()["block"]  # 1 to 4 and 6 are gone
    assert [x.split("\n")[0] for x in block.split("\n\n")] == ["ID: 0", "ID: 5", "ID: 7"]


def test_gzip_ratio(spark):
    import gzip

    rows = [("a" * 500,), ("é",), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(text.compression_ratio(F.col("t"))).collect()]
    assert got == [len(gzip.compress(t.encode())) / len(t.encode()) if t else None for (t,) in rows]


def test_redactions_name_kind_and_content(spark):
    secret = "aB3dE5fG7hI9jK1lM2nO4pQ6rS8tU0vWxYz"
    df = spark.createDataFrame([(f"a@x.org 555-123-4567 {secret} b@y.com",), ("none",), (None,)], "t string")
    got = [r[0] and [tuple(x) for x in r[0]] for r in df.select(text.redactions(F.col("t"))).collect()]
    assert got == [[("email", "a@x.org"), ("email", "b@y.com"), ("phone", "555-123-4567"), ("secret", secret)], [], None]


def test_pca_against_numpy(spark):
    x = np.random.default_rng(12).normal(size=(60, 5)) * [5, 3, 2, 1, 0.5]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    out, shares = cluster.reduce_dimensions(df, "v", 3)
    values, axes = np.linalg.eigh(np.cov(x.T))
    want = x @ axes[:, ::-1][:, :3]
    got = np.array([r["reduced"] for r in out.orderBy("id").collect()])
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)
    assert np.allclose(shares, values[::-1][:3] / values.sum(), atol=1e-9)
    assert cluster.explained_variance(shares) == [(2, pytest.approx(sum(shares[:2]))), (3, pytest.approx(sum(shares)))]


def test_clusters_without_rows_and_of_unbounded_groups(spark, monkeypatch):
    none = spark.createDataFrame([], "g int, id long, v array<double>")
    for f in (cluster.ward_clusters, cluster.density_clusters):
        out = f(none, ["g"], "id", "v")
        assert out.columns[:3] == ["g", "id", "label"] and out.count() == 0
    v = spark.createDataFrame([(u, u * 100 + i, [float(i)]) for u in (1, 2) for i in range(9)], "user_id long, conversation_id long, v array<double>")
    top = spark.createDataFrame([(1, 2, 0)], "user_id long, other_id long, match_group_id int")
    got = cluster.match_members(top, v, newest=4).groupBy("user_id").agg(F.min("conversation_id")).collect()
    assert {tuple(r) for r in got} == {(1, 105), (2, 205)}


def test_message_clusters_on_time_and_size(spark):
    words = " ".join(str(x) for x in range(400))
    rows = [(1, i, 60 * i, "ok") for i in range(20)] + [(1, 100 + i, 80_000 + 60 * i, words) for i in range(20)]
    df = spark.createDataFrame(rows, "g int, id long, s int, t string").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["id"]: r["label"] for r in cluster.message_clusters(df, ["g"], "id", "ts", "t").collect()}
    assert len({got[i] for i in range(20)}) == 1 and len({got[100 + i] for i in range(20)}) == 1 and got[0] != got[100]


def test_messenger_and_polling(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.json").write_text(json.dumps([{"datetime": "2024-01-01T10:00:00", "role": "Ann", "content": "hi"}, {"datetime": None, "role": "Bob", "content": "yo"}]))
    assert [(r["role"], str(r["datetime"])) for r in exports.read_messages(spark, str(tmp_path / "m")).orderBy("role").collect()] == [("Ann", "2024-01-01 10:00:00"), ("Bob", "None")]
    up = tmp_path / "up" / "u1" / "openai"
    up.mkdir(parents=True)
    (up / "latest.json").write_text(json.dumps([TREE, TREE]))
    q = exports.with_owner(exports.poll_uploads(spark, f"{tmp_path}/up/*/*")).select("user_id", "provider", "shape")
    q = q.writeStream.format("memory").queryName("polled").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.table("polled").collect()] == [("u1", "openai", "tree")] * 2


def test_live_update(spark):
    chat = lambda *texts: [("user" if i % 2 == 0 else "assistant", x) for i, x in enumerate(texts)]
    schema = "user_id long, conversation_id long, title string, messages array<struct<role: string, content: string>>"
    served = spark.createDataFrame([(1, 10, "a", chat("q", "old answer"), [1.0, 0.0]), (2, 20, "b", chat("q", "other"), [0.9, 0.1]), (3, 30, "c", chat("q", "far"), [0.0, 1.0])], schema + ", embedding array<double>")
    latest = spark.createDataFrame([(1, 10, "a", chat("q", "new answer")), (4, 40, "d", chat("q", "fresh")), (5, 50, "e", chat("q"))], schema)
    states = spark.createDataFrame([], "conversation_id long, status string, content_hash long")

    def embedder(texts):
        return [[1.0, 0.0] for _ in texts]

    after, st, hits = live.live_update(latest, served, states, embedder)
    assert {(r["conversation_id"], tuple(r["embedding"])) for r in after.collect()} == {(10, (1.0, 0.0)), (20, (0.9, 0.1)), (30, (0.0, 1.0)), (40, (1.0, 0.0))}
    assert {r["conversation_id"]: r["status"] for r in st.collect()} == {10: "completed", 40: "completed"}
    assert {(r["q_id"], r["c_id"]) for r in hits.collect()} == {(10, 20), (10, 40), (40, 10), (40, 20)}
    again = live.live_update(latest, after, st, embedder)
    assert again[2].count() == 0


def test_failed_groups_give_error_rows(spark, tmp_path):
    rows = [(1, g, g, "research", 10 * g + i, 1 if i < 3 else 2 + g, i, i < 3, None, "s", None) for g in range(2) for i in range(6)]
    df = spark.createDataFrame(rows, "current_user_id long, match_group_id int, cluster_id int, category string, row_idx int, user_id long, conversation_id long, mine boolean, title string, summary string, date_text string")

    def scorer(prompts):
        if any("ID: 10" in p for p in prompts):
            raise ValueError("no answer")
        return scoring.first_ids_path(prompts)

    got, bad = paths.discover_paths(df, lambda d: scoring.complete(d, "prompt", scorer, error="error"), paths.saver(spark, f"file://{tmp_path}"), total=2, with_errors=True)
    assert {(r["match_group_id"], r["other_user_id"]) for r in got.collect()} == {(0, 2)}
    assert {(r["match_group_id"], r["reason"]) for r in bad.collect()} == {(1, "no answer")} and bad.count() == 3


def test_periods_inverted(spark):
    df = spark.createDataFrame([("2024-12-21", "09:00:00", "2024-12-22", None)], "a string, b string, c string, d string")
    cols = [F.to_date("a"), F.col("b"), F.to_date("c"), F.col("d")]
    assert df.select(periods.relevance_period(*cols)).first()[0] == "2024-12-21 at 09:00:00 to 2024-12-22"
    assert df.select(periods.relevance_period(*cols, invert=True)).first()[0] is not None
    assert df.select(periods.relevance_period(F.lit(None), *cols[1:])).first()[0] == "Undefined scenario"


def test_matching_is_optimal():
    r = np.random.default_rng(1)
    for _ in range(60):
        s = r.normal(size=(r.integers(1, 6), r.integers(1, 7)))
        a = s if s.shape[0] <= s.shape[1] else s.T
        want = max(sum(a[i, p[i]] for i in range(len(a))) for p in permutations(range(a.shape[1]), len(a))) / len(a)
        assert abs(similarity.optimal_matching(s) - want) < 1e-9


def test_clusters_on_blobs(spark):
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(c, 0.1, (20, 2)) for c in ((0, 0), (5, 5), (0, 9))])
    truth = np.repeat([0, 1, 2], 20)
    for labels in (cluster.ward(x, 3), cluster.ward(x, distance=8.0)):
        assert len(set(zip(labels, truth))) == 3
    df = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)], "g int, id long, v array<double>")
    for out in (cluster.density_clusters(df, ["g"], "id", "v"), cluster.ward_clusters(df, ["g"], "id", "v", k=3)):
        assert len({(r["label"], r["id"] // 20) for r in out.collect()}) == 3
    capped = cluster.ward_clusters(df, ["g"], "id", "v", max_items=20)
    assert capped.groupBy("label").count().agg(F.max("count")).first()[0] <= 20


def test_change_points():
    gaps = np.array([1.0] * 20 + [600.0] * 20 + [1.0] * 20)[:, None]
    assert series.pelt(gaps) == [20, 40] and series.pelt(gaps[:4]) == []
    r = np.random.default_rng(3)

    def steps(n, cuts):
        cuts = np.sort(r.choice(np.arange(20, n - 20), cuts, replace=False))
        return cuts, (r.normal(size=(len(cuts) + 1, 2)) * 6)[np.searchsorted(cuts, np.arange(n), side="right")] + r.normal(size=(n, 2)) * 0.3

    pairs = []
    for n in (300, 300, 600, 600, 900, 900, 1_200, 1_200, 1_500, 1_900):
        cuts, x = steps(n, n // 150)
        pairs.append((series.pelt(x, whole=0), series.pelt(x)))  # features against the whole kernel
        assert set(pairs[-1][0]) <= {c + i for c in cuts for i in (-1, 0, 1)}
    assert sum(a == b for a, b in pairs) >= 9  # a change near the penalty may be missed by one of them
    cuts, x = steps(30_000, 120)  # a kernel of this series would have 7 GB
    got = series.pelt(x)
    assert set(got) <= set(cuts.tolist()) and len(got) >= 90


def test_z_score_without_spread(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0)], "g int, x double")
    assert {r[0] for r in df.select(balance.z_score("x", ["g"])).collect()} == {0.0}


def test_upsert_is_idempotent(spark):
    a = spark.createDataFrame([(1, "a", "t"), (2, "b", "t")], "k int, x string, created string")
    b = spark.createDataFrame([(2, "c", "s"), (3, None, "s")], "k int, x string, created string")
    once = serving.upsert(a, b, ["k"], keep=("created",))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, serving.upsert(once, b, ["k"], keep=("created",)).collect()))
    assert {tuple(r) for r in once.collect()} == {(1, "a", "t"), (2, "c", "t"), (3, None, "s")}
    assert {tuple(r) for r in serving.upsert(a, b.withColumn("x", F.lit(None).cast("string")), ["k"], null_safe=True).collect()} >= {(2, "b", "s")}


def test_queue_closed_form(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(x)) for i, x in enumerate(rng.integers(0, 900, 40))]
    df = spark.createDataFrame(rows, "user_id int, s int").withColumn("created_at", F.timestamp_seconds(F.col("s")))
    got = {r["user_id"]: r["finish"] for r in serving.queue_finish(df, F.timestamp_seconds(F.lit(900))).collect()}
    end = 0.0
    for i, s in sorted(rows, key=lambda r: (r[1], r[0])):
        end = max(end, max(0, 8 - (900 - s) / 60)) + 2
        assert abs(got[i] - end) < 1e-6


def test_path_rounds(spark, tmp_path):
    rows = []
    for g in range(2):
        for c in range(3):
            for i in range(8):
                mine = i % 2 == 0
                rows.append((1, g, c, ["research", "practical", "coding"][c], len(rows), 1 if mine else 2 + g, len(rows) + 100, mine, None, f"s{i}", None))
    df = spark.createDataFrame(rows, "current_user_id long, match_group_id int, cluster_id int, category string, row_idx int, user_id long, conversation_id long, mine boolean, title string, summary string, date_text string")
    save = paths.saver(spark, f"file://{tmp_path}")
    got = paths.discover_paths(df, lambda d: scoring.complete(d, "prompt", scoring.first_ids_path), save, total=4).collect()
    assert got and {r["category"] for r in got} == {"research", "practical"}
    for g in range(2):
        ids = [x for r in got if r["match_group_id"] == g for x in (*r["common"], *r["user1"], *r["user2"])]
        assert len(ids) == len(set(ids))
    few = paths.discover_paths(df, lambda d: scoring.complete(d, "prompt", scoring.first_ids_path), save, total=4, budget=1).collect()
    assert len(few) == 1
    none = paths.discover_paths(df, lambda d: d.withColumn("answer", F.lit("{}")), save, total=2, retries=1)
    assert none.count() == 0
    cut_off = paths.discover_paths(df, lambda d: scoring.complete(d, "prompt", lambda p: ["Sure: " + a[:-10] for a in scoring.first_ids_path(p)]), save, total=4, budget=1).collect()
    assert [(r["common"], r["user1"], r["user2"]) for r in cut_off] == [(r["common"], r["user1"], r["user2"]) for r in few]


def plain_paths(mine, theirs, category, vec):
    """Path rounds of one match group in a plain loop: 10 paths, 2 retries, ids of a side by cluster."""
    out, tries = [], dict.fromkeys(mine, 0)

    def measures(c):
        s = np.array([[np.dot(vec[i], vec[j]) for j in theirs[c]] for i in mine[c]])
        a = s if s.shape[0] <= s.shape[1] else s.T
        best = max(sum(a[i, p[i]] for i in range(len(a))) for p in permutations(range(a.shape[1]), len(a))) / len(a)
        return abs(np.log(len(mine[c]) / len(theirs[c]))), 1 - best

    for name, want in (("humanistic", 4), ("research", 4), ("practical", 2)):
        n, scale = 0, None
        while n < want and len(out) < 10:
            size = {c: measures(c) for c in mine if category[c] == name and mine[c] and theirs[c]}
            if scale is None:
                scale = [(np.mean(m), np.std(m)) for m in zip(*size.values())] if size else []
            live = [(round(sum((x - m) / s if s > 1e-12 else 0.0 for x, (m, s) in zip(xs, scale)), 9), c) for c, xs in size.items() if tries[c] <= 2]
            if not live:
                break
            c = min(live)[1]
            a, b = mine[c][:3], theirs[c][:3]
            mine[c], theirs[c] = mine[c][3:], theirs[c][3:]
            if len(a) > 1 and len(b) > 1:
                out.append((c, name, len(out), sorted((a[0], b[0])), a[1:], b[1:]))
                n += 1
            else:
                tries[c] += 1
    return out


def test_discovered_paths_against_plain_loop(spark, tmp_path):
    r = np.random.default_rng(5)
    users = [(u, label) for label in range(12) for u in (0, 1) for _ in range(int(r.integers(4, 8)))]
    unit = [x / np.linalg.norm(x) for x in r.normal(size=(len(users), 4))]
    rows = [(20 * i + u, unit[i].astype("float32").tolist(), label) for i, (u, label) in enumerate(users)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    category = {c: ("research", "humanistic", "practical", "coding")[c % 4] for c in range(12)}
    got = registry.QUERIES["p11_discover_paths"](spark, str(tmp_path)).collect()
    for me in (0, 1):
        order = sorted((label, i % 20, i) for i, _, label in rows)
        vec = [np.array(rows[i // 20][1]) for _, _, i in order]
        side = [{c: [n for n, (label, u, _) in enumerate(order) if label == c and (u == me) == mine] for c in range(12)} for mine in (True, False)]
        want = plain_paths(*side, category, vec)
        assert len(want) == 10
        own = sorted((x for x in got if x["current_user_id"] == me), key=lambda x: x["path_seq"])
        assert [(x["cluster_id"], x["category"], x["path_seq"], x["common"], x["user1"], x["user2"]) for x in own] == want


def test_completions(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, p string")
    seq = scoring.complete_sequence(df, [F.col("p"), lambda a: F.concat(a, F.lit("!"))], lambda ps: [p + "x" for p in ps])
    assert {r["id"]: r["completions"] for r in seq.collect()} == {1: ["ax", "ax!x"], 2: []}

    def embedder(texts):
        if any(t is None for t in texts):
            raise ValueError("null")
        return [[float(len(t))] for t in texts]

    got = {r["id"]: (r["embedding"], r["error"]) for r in scoring.embed(df, "p", embedder, batch=1).collect()}
    assert got == {1: ([1.0], None), 2: (None, "null")}


def test_completion_parsing(spark):
    cases = ['{"summary": "s", "is_sensitive": true}', 'x ```json\n{"summary": "s", "is_sensitive": false}\n``` y', '{"summary": 1, "is_sensitive": true}', "no", "{}", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    got = [r["s"] and tuple(r["s"]) for r in df.select("i", assemble.parse_summary(F.col("c")).alias("s")).orderBy("i").collect()]
    assert got == [("s", True), ("s", False), None, None, None, None]


def test_shortest_path_without_way(spark, tmp_path):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y")], "src string, dst string")
    save = paths.saver(spark, f"file://{tmp_path}")
    assert sorted(map(tuple, graph.shortest_path(e, "a", "c", save).collect())) == [(0, "a"), (1, "c")]
    assert graph.shortest_path(e, "a", "y", save).count() == 0
    assert [tuple(r) for r in graph.shortest_path(e, "a", "a", save).collect()] == [(0, "a")]
    chain = spark.createDataFrame([(i, i + 1) for i in range(54)] + [(i, i) for i in range(54)], "src long, dst long")
    assert sorted(map(tuple, graph.shortest_path(chain, 0, 52, save).collect())) == [(i, i) for i in range(53)]
    assert graph.shortest_path(chain, 0, 52, save, most=5).count() == 0


def test_streams_equal_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src = str(tmp_path / "in")
    events.select("user_id", "event_type", "ts", "event_id").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("user_id long, event_type string, ts timestamp, event_id long").parquet(src)
    for name, out, mode in (("ch", snapshots.changed_stream(stream, "user_id", "event_type", "ts", "1000 days"), "append"), ("db", snapshots.debounced_stream(stream, "user_id", "event_id", "ts", 600, "1 second"), "append")):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
    want = snapshots.changed(events, "user_id", ["ts", "event_type"], "event_type", "ts", 86_400).count()
    assert spark.table("ch").count() == want
    batch = {r["event_id"] for r in snapshots.settled(events, "user_id", "ts", ["ts", "event_id"], 600).collect()}
    got = {r["event_id"] for r in spark.table("db").collect()}
    assert got <= batch and len(batch) - len(got) <= 3  # sessions still open at the end
    seen = []
    snapshots.run_live(stream, lambda df, _: seen.append(df.count()), str(tmp_path / "live"), "user_id").awaitTermination(120)
    assert seen and seen[0] == events.select("user_id").distinct().count()


def test_state_of_changed_keys_ends(spark, tmp_path):
    """Batches of one file each: keys that fall silent leave the state, and what is emitted equals the batch."""
    schema = "k long, v string, ts timestamp"
    # times after 1970 began, which is where a watermark starts
    plan = [[(1, "a", 100), (2, "b", 101), (3, "c", 102)], [(1, "a", 130), (2, "x", 140)], [(4, "d", 5_000)], [(1, "a", 9_000)], [(9, "z", 30_000)], [(9, "y", 60_000)]]
    rows = []
    for n, batch in enumerate(plan):
        df = spark.createDataFrame(batch, "k long, v string, ts long").withColumn("ts", F.timestamp_seconds("ts"))
        df.coalesce(1).write.parquet(f"{tmp_path}/in/b={n}")
        for f in (tmp_path / "in" / f"b={n}").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + n, 1_700_000_000 + n))  # a stream takes files by their time
        rows += batch
    out = snapshots.changed_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"), "k", "v", "ts", silence=3_600)
    q = out.writeStream.format("memory").queryName("ended").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination(300)
    total = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(total) >= 3 and total[-1] == 1  # the last batch's key, of five
    all_rows = spark.createDataFrame(rows, "k long, v string, ts long").withColumn("ts", F.timestamp_seconds("ts"))
    want = snapshots.changed(all_rows, "k", ["ts"], "v", "ts", 3_600).select("k", "v", "ts").collect()
    assert sorted(map(tuple, spark.table("ended").collect())) == sorted(map(tuple, want)) and len(want) == 8
