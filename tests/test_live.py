"""Live tables under a stream, with restarts."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from convmatch.operators import scoring
from convmatch.operators.versions import Versions
from convmatch.plans import registry
from convmatch.streaming import live

MESSAGES = "array<struct<role: string, content: string>>"
SCHEMA = f"user_id long, conversation_id long, title string, messages {MESSAGES}, ts timestamp"
STATES = "conversation_id long, status string, content_hash long"


def chat(i, version=0):
    words = np.random.default_rng(1000 * version + i % 4).choice(["tea", "ship", "moon", "loop", "salt", "wool", "cart"], 6)
    return [("user", f"about {words[0]}"), ("assistant", " ".join(words) + f" {i % 3}")]


def batches():
    """Micro-batches: new conversations, changed ones, repeats, and some that are not ready."""
    out = []
    for b in range(4):
        rows = [(i % 6, i, f"t{i}", chat(i, b if i % 3 == 0 else 0), b) for i in range(10 * b, 10 * b + 20)]
        out.append(rows + [(1, 500 + b, "not ready", [("user", "q")], b), (2, 600, None, chat(3), b)])
    return out


def frames(spark):
    return [spark.createDataFrame(rows, SCHEMA.replace("ts timestamp", "ts long")).withColumn("ts", F.timestamp_seconds("ts")) for rows in batches()]


def key(rows):
    return sorted(tuple(str(x) for x in r) for r in rows)


def test_stream_equals_batch_after_a_restart(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}"
    start = spark.createDataFrame([(9, 900 + i, f"s{i}", chat(i)) for i in range(12)], SCHEMA.rpartition(",")[0])
    served = scoring.embed(start.withColumn("_t", F.col("messages")[1]["content"]), "_t", scoring.hashed_words).select(*live.COLUMNS, "embedding")
    none = spark.createDataFrame([], STATES)
    after, states, hits = served, none, {}
    for df in frames(spark):
        after, states, found = live.live_update(df, after, states, scoring.hashed_words)
        after, states = (spark.createDataFrame(x.collect(), x.schema) for x in (after, states))
        rows = found.collect()
        hits |= {r["q_id"]: [] for r in rows}
        for r in rows:
            hits[r["q_id"]].append((r["rank"], r["c_id"], r["c_user"], round(r["distance"], 5), r["meets"]))
    for n, df in enumerate(frames(spark)):
        df.coalesce(1).write.parquet(f"{root}/in/batch={n}")
        for f in (tmp_path / "in" / f"batch={n}").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + n, 1_700_000_000 + n))  # a stream takes files by their time
    tables = live.LiveTables(Versions(spark, f"{root}/tables"), scoring.hashed_words, probes=10**6)
    tables.start(served, none, dim=64)
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{root}/in/*")
    publish, lost = Versions.publish, []

    def once(self, base, *args, **kwargs):
        if base.commits.get("live") == 1 and not lost:  # the third batch is lost before it is published
            lost.append(1)
            raise RuntimeError("lost")
        return publish(self, base, *args, **kwargs)

    monkeypatch.setattr(Versions, "publish", once)
    with pytest.raises(Exception, match="lost"):
        tables.run(stream(), f"{root}/checkpoint").awaitTermination()
    assert tables.versions.current().commits == {"live": 1}
    tables.run(stream(), f"{root}/checkpoint").awaitTermination()
    assert lost and tables.versions.current().commits == {"live": 3}

    def check():
        assert key(tables.served().select(*after.columns).collect()) == key(after.collect())
        assert key(tables.states().select(*states.columns).collect()) == key(states.collect())
        got = {}
        for r in tables.hits().orderBy("q_id", "rank").collect():
            got.setdefault(r["q_id"], []).append((r["rank"], r["c_id"], r["c_user"], round(r["distance"], 5), r["meets"]))
        assert got.keys() == hits.keys()
        for q in got:  # equal distances in single precision may change places
            assert np.allclose([x[3] for x in got[q]], [x[3] for x in sorted(hits[q])], atol=1e-4)
            assert [x[4] for x in got[q]] == [x[4] for x in sorted(hits[q])]

    check()
    version = tables.versions.current().version
    tables.handle(frames(spark)[3], 3)  # replayed
    assert tables.versions.current().version == version
    tables.compact()
    check()
    tables.handle(spark.createDataFrame([(7, 1, "t1", chat(1, 9))], SCHEMA.rpartition(",")[0]), 4)
    assert tables.served().where("conversation_id = 1").first()["user_id"] == 7
    assert {r["status"] for r in tables.states().collect()} == {"completed"}


def test_failed_embeddings_are_states_and_are_tried_again_when_changed(spark, tmp_path):
    def embedder(texts):
        if any("bad" in t for t in texts):
            raise ValueError("no")
        return scoring.hashed_words(texts)

    tables = live.LiveTables(Versions(spark, f"file://{tmp_path}"), embedder)
    empty = spark.createDataFrame([], f"user_id long, conversation_id long, title string, messages {MESSAGES}, embedding array<double>")
    tables.start(empty, spark.createDataFrame([], STATES), dim=64)
    one = lambda text: spark.createDataFrame([(1, 1, "t", [("user", "q"), ("assistant", text)])], SCHEMA.rpartition(",")[0])
    tables.handle(one("bad answer"), 0)
    assert [r["status"] for r in tables.states().collect()] == ["error"] and tables.served().count() == 0
    tables.handle(one("bad answer"), 1)
    tables.handle(one("good answer"), 2)
    assert [r["status"] for r in tables.states().collect()] == ["completed"] and tables.served().count() == 1
    assert tables.hits().count() == 0


def test_query_against_all_pairs(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect()
    talks = {}
    for r in c:
        talks.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    v = dict(zip(talks, scoring.hashed_words(["\n".join(f"{a}: {b}" for a, b in m) for m in talks.values()])))
    got = {}
    for r in registry.QUERIES["z8_live_hits"](spark, sf).collect():
        got.setdefault(r["q_id"], set()).add(r["c_id"])
    ready = [i for i, m in talks.items() if i % 2 and len(m) > 1 and m[-1][0] == "assistant" and len(m[-1][1]) > 1]
    assert set(got) == set(ready)
    shared = total = 0
    for q in ready:
        seen = [i for i in talks if i % 20 != q % 20 and (i % 2 == 0 or i in ready)]
        best = sorted(seen, key=lambda i: (-np.dot(v[q], v[i]), i))[:5]
        near = [i for i in best if 1 - np.dot(v[q], v[i]) <= live.LIMIT]
        want = set(near or best)
        shared, total = shared + len(want & got[q]), total + len(want)
    assert shared >= 0.9 * total
