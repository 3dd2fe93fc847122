"""Texts that take no part in a join are not dealt between tasks; the results are the same."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from convmatch.llm import jaccard_join, quality_rules, substring_dedup
from convmatch.llm.common import left_out, sifted, written

from . import brute


@pytest.fixture
def plain_joins(spark):
    """No small side is broadcast unasked, as on large tables."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(key)
    spark.conf.set(key, "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set(key, was)
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def dealt(spark, run):
    """The result of ``run`` and the bytes that it wrote to shuffles."""

    def total():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    before = total()
    out = run()
    return out, total() - before


def corpus(spark, docs=400, words=600):
    """Distinct words that compress badly, few shingles of which are listed; of every hundredth text an edited copy."""
    r = random.Random(3)
    rows = []
    for i in range(docs):
        w = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=24)) for _ in range(words)]
        rows.append((i, " ".join(w)))
        if i % 100 == 0:
            rows.append((docs + i, " ".join([*w[:-3], "x", "y", "z"])))
    return rows, written(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))


def test_near_duplicates_deal_only_texts_of_pairs(plain_joins):
    rows, df = corpus(plain_joins)
    size = sum(len(t) for _, t in rows)
    got, moved = dealt(plain_joins, lambda: [tuple(r) for r in jaccard_join.near_duplicates(df).select("doc_id", "n_shingles", "component_id").collect()])
    assert Counter(got) == Counter(brute.groups(rows, 4, 85))
    assert len({c for _, _, c in got}) == 400
    assert moved < 0.6 * size


def test_stages_deal_only_rows_that_may_change(plain_joins):
    rows, df = corpus(plain_joins)
    size = sum(len(t) for _, t in rows)
    kept, moved = dealt(plain_joins, lambda: {tuple(r) for r in jaccard_join.keep_one_of_each(df, 5, 80).collect()})
    assert kept == set(rows[i] for i in range(len(rows)) if rows[i][0] < 400)
    assert moved < 0.6 * size
    labelled = written(df.withColumns({"lang": F.lit("en"), "source": F.lit("s")}))
    kept, moved = dealt(plain_joins, lambda: quality_rules.keep_good(labelled).count())
    assert kept > 380
    assert moved < 0.6 * size


def test_sifted_loses_nothing(spark):
    rows = spark.range(20_000).select("id", (F.col("id") % 7).alias("_x")).unionByName(spark.createDataFrame([(None, 1)], "id long, _x long"))
    keys = written(spark.range(0, 40_000, 3).select(F.col("id")))
    others, maybe = sifted(rows, keys, ["id"])
    assert others.columns == maybe.columns == ["id", "_x"]
    assert others.count() + maybe.count() == 20_001
    assert others.join(keys, "id").count() == 0
    assert left_out(rows, keys, ["id"]).count() == rows.join(keys, "id", "left_anti").count()
    assert left_out(rows, keys.limit(0), ["id"]).count() == 20_001


def test_dropped_passages_with_and_without_repeats(plain_joins):
    r = random.Random(5)
    passage = " ".join(f"p{r.randrange(10**9)}" for _ in range(50))
    rows = [(i, " ".join(f"w{r.randrange(10**9)}" for _ in range(80)) + (f" {passage}" if i % 10 == 0 else "")) for i in range(60)]
    rows += [(None, None), (60, ""), (61, "a few words")]
    got = {tuple(r) for r in substring_dedup.drop_repeats(plain_joins.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i, t.replace(f" {passage}", "") if t else t) for i, t in rows}
