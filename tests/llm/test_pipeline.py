from collections import defaultdict

import corpus_pipeline
from convmatch.llm.common import table, written

from . import brute


def test_stages_on_whole_documents(spark, sf):
    docs = table(spark, sf, "documents")
    n = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()} if name != "best_fit_packing" else {}
        out = written(stage(spark, docs, sf))
        n[name] = out.count()
        if name != "best_fit_packing":
            assert out.columns == docs.columns
            after = {r["doc_id"]: r["text"] for r in out.collect()}
            if name == "ngram_jaccard_join":
                want = {d for d, _, c in brute.groups(sorted(before.items()), 5, 80) if d == c}
                assert set(after) == want
            if name == "substring_dedup":
                gone = {d: r for d, _, r, _ in brute.repeats(sorted(before.items()), 35)}
                assert set(after) == set(before)
                for d, t in after.items():
                    assert len(before[d].encode().split()) - len(t.encode().split()) == gone[d]
                    assert gone[d] or t == before[d]
        docs = out
    bins = defaultdict(int)
    for r in docs.collect():
        bins[r["sequence_id"]] += r["length"]
    assert max(bins.values()) <= 2048
    assert n["quality_rules"] >= n["language_id"] >= n["ngram_jaccard_join"] == n["substring_dedup"] > 0


def test_stages_on_odd_rows(spark, sf):
    from .test_operators import SCHEMA, edge_rows

    docs = spark.createDataFrame(edge_rows(), SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        for df in (docs, docs.limit(0)):
            out = stage(spark, df, sf)
            assert name == "best_fit_packing" or out.columns == docs.columns
            out.count()
