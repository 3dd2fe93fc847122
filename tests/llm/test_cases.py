"""Cases that broke an operator once, and comparisons with plain models."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from convmatch.llm import ann, jaccard_join, language_id, license_scan, packing, piece_codec, quality_model, quality_rules, queries, sharding, substring_dedup
from convmatch.llm.common import key_doc_id, row_key, table, written

from . import brute
from .test_operators import brute_search, key, pairs, prose


def test_row_keys_of_null_ids(spark):
    texts = spark.range(300_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    assert texts.select(*row_key()).distinct().count() == 300_000
    ids = spark.createDataFrame([(-(2**63), "a"), (None, "a"), (0, None), (None, None), (2**63 - 1, "")], "doc_id long, text string")
    assert [r[0] for r in ids.select(*row_key(), "doc_id").select(key_doc_id()).collect()] == [-(2**63), None, 0, None, 2**63 - 1]


@pytest.mark.parametrize("window,hot", [(1, 1000), (5, 1000), (5, 1), (8, 1000), (63, 1000), (71, 1), (100, 1000)])
def test_substring_dedup_windows(spark, window, hot):
    r = random.Random(window)
    base = [prose(700 + i, 150).split() for i in range(4)]
    rows = []
    for i in range(24):
        a, b = r.choice(base), r.choice(base)
        cut = r.randrange(20, 130)
        rows.append((i if i % 5 else None, " ".join(a[:cut] + [f"x{i}"] + b[cut:])))
    rows.append((-(2**63), "na " * 300))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(x) for x in substring_dedup.remove_repeats(df, window, hot=hot, shard_words=500).collect()]
    assert key(got) == key(brute.repeats(rows, window))


def test_language_of_copies(spark):
    """A language whose rows are copies of a few texts is learned like others."""
    few = [" ".join(random.Random(i).choice(["zorp", "blim", "quax", "fnord"]) for _ in range(30)) for i in range(8)]
    rows = [(i, few[i % 8], "bb") for i in range(20_000)] + [(100_000 + i, prose(i, 30), "aa") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit_language_model(df, per_language=100)
    assert model.languages == ["aa", "bb"]
    got = language_id.detect_language(df, model).groupBy((F.col("doc_id") < 100_000).alias("b"), "lang_pred").count().collect()
    assert {(r["b"], r["lang_pred"]) for r in got} == {(True, "bb"), (False, "aa")}


def test_language_decoding_in_a_plain_loop(spark, sf):
    docs = table(spark, sf, "documents")
    model = language_id.fit_language_model(docs)
    rows = [r for r in docs.collect() if r["text"] and language_id._LETTER.search(r["text"])][:40]
    for r, lang, score in zip(rows, *model.predict([r["text"] for r in rows])[:2]):
        x = np.append(language_id.ngram_features(r["text"]), 1.0)
        loss = []
        for c in range(len(model.languages)):
            total = 0.0
            for b in range(model.code.shape[1]):
                margin = model.code[c, b] * (x @ model.weights[:, b])
                total += model.bit_weight[c, b] * max(0.0, 1 - margin) ** 2
            loss.append(total)
        p = np.exp(-model.sharpness * (np.array(loss) - min(loss)))
        assert lang == model.languages[int(np.argmin(loss))] and abs(score - p.max() / p.sum()) < 1e-9
    # the fit is the ridge solution on the features of all distinct training texts
    train = docs.where(~language_id.held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text").distinct().collect()
    x = np.array([np.append(language_id.ngram_features(r["text"]).astype(np.float32), 1.0) for r in train], dtype=float)
    y = np.array([model.languages.index(r["lang"]) for r in train])
    w = len(y) / len(model.languages) / np.bincount(y)[y]
    gram = x.T @ (x * w[:, None]) + 1e-3 * len(y) * np.eye(x.shape[1]) / 2048
    assert np.allclose(np.linalg.solve(gram, x.T @ (model.code[y] * w[:, None])), model.weights, atol=1e-6)


def test_packing_limits_and_ids(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    encode = packing._encoding(queries.vocabulary("byte_bpe_50k.tiktoken")).encode_to_numpy
    r = random.Random(4)
    odd = ["ab", " ", "\n", "\t", "'s", "'LL", "é", "中文", "🙂", "<|endoftext|>", "123", "１", " ", "é", "_", "%%", "\x00", "​", "A"]
    for _ in range(3000):
        t = "".join(r.choice(odd) for _ in range(r.randrange(25)))
        assert encode(t, allowed_special="all").tolist() == tok.encode(t, add_special_tokens=False).ids
    # one text a thousand times over, with null ids, and empty texts
    rows = [(None, "same text here")] * 1000 + [(i, "") for i in range(3000)] + [(None, None)] * 10 + [(9000 + i, prose(i, 5 + 40 * i)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for most, attention in ((2048, 2048**2), (256, 2048**2), (9, 2048**2 + 9)):
        bins = defaultdict(list)
        for x in packing.pack_documents(df, queries.vocabulary("byte_bpe_50k.tiktoken"), max_docs=most, max_attention=attention).collect():
            bins[x["sequence_id"]].append((x["offset"], x["length"]))
        lengths = [n for b in bins.values() for _, n in b]
        rest = [n for n in lengths if n < 2048]  # a full piece has its sequence for itself
        for b in bins.values():
            b.sort()
            assert [o for o, _ in b] == [0, *np.cumsum([n for _, n in b])[:-1]] and len(b) <= most
            assert sum(n for _, n in b) <= 2048 and sum(n * n for _, n in b) <= attention
        used, tokens, docs = len(bins) - (len(lengths) - len(rest)), sum(rest) / 2048, len(rest) / most
        assert used <= (1.03 * tokens if most == 2048 else tokens + docs) + 2


def found_by(df, **options):
    got = defaultdict(list)
    for r in ann.search(df, **options).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got[r["query_id"]]) + 1
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    return got


def recall_of(got, want):
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    return sum(len({x for x, _ in got[q]} & {x for x, _ in want[q]}) for q in want) / sum(map(len, want.values()))


def test_search_with_norms_of_all_sizes(spark):
    r = np.random.default_rng(8)
    rows = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(400, 8)))]
    for extra in ([(1001, [1e200] * 8)], [(1001 + i, (r.normal(size=8) * 10.0**e).tolist()) for i, e in enumerate((-200, -30, -3, 3, 30, 150))]):
        df = spark.createDataFrame(rows + extra, "vec_id long, embedding array<double>")
        want = brute_search([(x["vec_id"], x["embedding"]) for x in df.collect()], 20, 20)
        assert recall_of(found_by(df), want) >= 0.95
    both = spark.createDataFrame([(20, [1e300, -1e300]), (1, [1e300, 1e300]), (2, [1.0, 0.0]), (3, [1e300, 0.0])], "vec_id long, embedding array<double>")
    assert [x for x, _ in found_by(both)[20]] == [3, 2, 1]  # the product with 1 is no number


def test_search_with_repeated_ids_and_two_lengths(spark):
    r = np.random.default_rng(9)
    rows = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(100, 6)))] + [(20, r.normal(size=6).tolist()), (20, r.normal(size=6).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found_by(df)
    assert {q: len(x) for q, x in got.items()} == {q: 20 for q in (0, 20, 40, 60, 80)}
    own = min(v for i, v in rows if i == 20)
    want = brute_search([(i, v) for i, v in rows if i != 20] + [(20, own)], 20, 20)
    assert got[20] == [(i, pytest.approx(s)) for i, s in want[20]]
    assert all(i != 20 for i, _ in got[20])
    two = rows + [(200 + i, v.tolist()) for i, v in enumerate(r.normal(size=(70, 3)))]
    got = found_by(spark.createDataFrame(two, "vec_id long, embedding array<double>"))
    want = brute_search([(i, v) for i, v in two if len(v) == 3], 20, 20)
    assert recall_of({q: got[q] for q in want}, want) >= 0.95 and set(got) == {0, 20, 40, 60, 80, 200, 220, 240, 260}


def test_search_recall_with_a_small_sample(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, sf.replace("0.001", "0.1"), "embeddings").collect()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for every, sample in ((20, 600), (50, 300)):
        got = found_by(df, query_every=every, max_sample=sample, block_rows=300)
        assert recall_of(got, brute_search(rows, every, 20)) >= 0.9


def test_least_determinant_against_all_subsets(spark):
    """In small groups, the determinant of the subset found is hardly above the least of all."""
    r = np.random.default_rng(3)
    groups, rows = {}, []
    for g in range(40):
        x = r.normal(scale=0.3, size=(10, 4))
        x[:2] += r.normal(scale=3, size=4)  # two outliers
        groups[f"g{g}"] = x
        rows += [(f"g{g}", *map(float, v)) for v in x]
    df = spark.createDataFrame(rows, "_g string, _x0 double, _x1 double, _x2 double, _x3 double")
    got = {x["_g"]: x["_det"] for x in quality_rules.robust_scatter(df).collect()}
    floor = np.diag(np.array(quality_rules._FLOORS) ** 2)
    near = 0
    for g, x in groups.items():
        least = min(np.linalg.slogdet(np.cov(x[list(s)].T, bias=True) + floor)[1] for s in combinations(range(10), 8))
        assert least - 1e-9 <= got[g] <= least + 1.5
        near += got[g] <= least + 1e-6
    assert near >= 30


def test_quality_verdict_in_plain_numpy(spark, sf):
    """Distances and verdicts from the fitted estimates, one row at a time; labels as a check."""
    sf = sf.replace("0.001", "0.01")
    docs = table(spark, sf, "documents")
    stats = written(quality_rules.with_stats(docs).select("doc_id", "lang", "source", "_s"))
    params = {r["_g"]: r for r in quality_rules.fit_robust(stats).collect()}
    got = {r["doc_id"]: r for r in quality_rules.judge_quality(docs).collect()}
    f = {r["doc_id"]: r for r in stats.select("doc_id", quality_rules.group_key().alias("g"), F.array(*quality_rules.features()).alias("x")).collect()}
    for d, r in got.items():
        p = params.get(f[d]["g"])
        if p is None:
            assert not r["kept"] and r["distance"] is None
            continue
        c = np.array([[p[f"c{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
        y = np.array(f[d]["x"]) - np.array([p[f"m{i}"] for i in range(4)])
        want = y @ np.linalg.inv(c @ c.T) @ y / p["_scale"]
        assert abs(want - r["distance"]) <= 1e-6 * (1 + want)
        assert r["kept"] == (not r["base_failed"] and want <= 40)
    labels = [(got[r["doc_id"]], r) for r in table(spark, sf, "labels").collect() if r["doc_id"] in got]
    good = [g["kept"] for g, r in labels if r["quality"] == 1 and r["toxic"] == 0]
    bad = [g["kept"] for g, r in labels if r["quality"] == 0 and not g["base_failed"]]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.5


def test_quality_model_on_held_out_labels(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality_model.fit_quality_model(docs, labels.where("doc_id % 2 = 0"))
    got = quality_model.grade_documents(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    clean = [r["kept"] for r in got if r["quality"] == 1 and r["toxic"] == 0]
    bad = [r["kept"] for r in got if r["quality"] == 0 or r["toxic"] == 1]
    assert sum(clean) / len(clean) > 0.93 and 1 - sum(bad) / len(bad) > 0.75
    rank = np.array([r["expected_grade"] for r in got])[np.argsort([0 if r["toxic"] else 1 + r["quality"] for r in got], kind="stable")]
    n = sum(r["toxic"] for r in got)
    assert rank[:n].mean() < rank[n:].mean()


def test_quality_model_against_plain_gradient():
    """Two features: the weights and thresholds of a plain descent on the same likelihood."""
    r = np.random.default_rng(6)
    x = r.normal(size=(400, 2))
    grade = np.digitize(1.5 * x[:, 0] - x[:, 1] + r.logistic(size=400), [-1.0, 1.5])
    rows = [(np.array([1, 2]), v) for v in x]
    model = quality_model.train_ordinal(rows, grade, 3, steps=3000)
    share = 400 / 3 / np.bincount(grade)[grade]

    def loss(p):
        cut = np.array([p[2], p[2] + np.exp(p[3])])
        below = np.hstack([np.zeros((400, 1)), 1 / (1 + np.exp(x @ p[:2, None] - cut[None])), np.ones((400, 1))])
        own = below[np.arange(400), grade + 1] - below[np.arange(400), grade]
        return -(share * np.log(own)).mean() + 1e-4 * (p[:2] ** 2).sum()

    p = np.zeros(4)
    for _ in range(4000):
        step = np.array([(loss(p + e) - loss(p - e)) / 2e-5 for e in np.eye(4) * 1e-5])
        p -= 0.5 * step
    assert np.allclose(model.weights[1:3], p[:2], atol=0.05) and np.allclose(model.thresholds, [p[2], p[2] + np.exp(p[3])], atol=0.05)


def test_subset_boundary_follows_cost():
    many_small = {n: 1000 for n in range(1, 20)}
    assert jaccard_join.subset_boundary(many_small, 0.0, 85) < jaccard_join.subset_boundary(many_small, 1.0, 85)
    assert jaccard_join.subset_boundary({60: 5}, 1.0, 85) == 0
    for small in (0, 5, 14):
        assert jaccard_join.subsets(small, 85) == sum(1 for c in range(jaccard_join.least_subset(small, 85), small + 1) for _ in combinations(range(small), c))


def test_near_duplicates_of_null_ids_and_odd_columns(spark):
    t = prose(5, 80)
    rows = [(None, t, "x"), (None, t, "y"), (3, t, None), (-(2**63), t, "z"), (7, prose(6, 80), "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _set string")
    got = Counter(tuple(r) for r in jaccard_join.near_duplicates(df).select("doc_id", "component_id").collect())
    assert got == Counter({(None, None): 2, (3, -(2**63)): 1, (-(2**63), -(2**63)): 1, (7, 7): 1})
    kept = jaccard_join.keep_one_of_each(df)
    assert kept.columns == df.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter({None: 2, -(2**63): 1, 7: 1})
    assert len(pairs(kept)) == 4


def test_licences_inside_longer_texts(spark, tmp_path):
    """A licence after 700 lines of other words, a sentence in a line, and a tag, in Spark and in SQL."""
    import duckdb

    text = dict(license_scan.default_templates())
    names = ["Apache-2.0", "ISC", "MPL-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "Zlib", "Unlicense", "CC0-1.0"]
    before = "\n".join(prose(5000 + i, 9) for i in range(700))
    rows = [(i, f"{before}\n\n{text[n]}\n{prose(i, 30)}") for i, n in enumerate(names)]
    rows += [(100, before + " This project is licensed under the MIT License. " + before), (101, "# SPDX-License-Identifier: GPL-3.0\nimport x"), (102, prose(1, 40) + " The code of this page is Released under the MIT License."), (103, before)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, w string")
    got = [tuple(r) for r in license_scan.scan_licenses(df).collect()]
    found = {(d, n) for d, n, *_ in got}
    assert {(i, n) for i, n in enumerate(names)} <= found
    assert {n for d, n in found if d >= 100} == {"MIT", "GPL-3.0"} and {d for d, _ in found if d >= 100} == {100, 101, 102}
    best = {}
    for d, n, _, _, dice in got:
        best[d] = max(best.get(d, (0, "")), (dice, n))
    assert all(best[i][0] > 0.95 for i in range(len(names)))
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    assert key(got) == key(con.sql(license_scan.oracle()).fetchall())


def test_repeated_rows_in_number(spark):
    """Repeated rows cost what different rows of that length cost."""
    import time

    text, took = prose(77, 300), []
    for n, rows in ((2, [(None, text)] * 2), (20_000, [(i, prose(i % 97, 20) + f" w{i} " * 280) for i in range(20_000)]), (20_000, [(None, text)] * 20_000)):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
        t = time.monotonic()
        got = substring_dedup.remove_repeats(df, 35).groupBy("n_words", "n_removed").count().collect()
        took.append(time.monotonic() - t)
        if rows[0][0] is None:
            assert [tuple(r) for r in got] == [(300, 300, n)]
    assert took[2] < 2 * took[1] + 5


def test_known_passages_through_broadcast_automata(spark, sf):
    docs = table(spark, sf, "documents")
    known = table(spark, sf, "benchmark")
    got = [tuple(r) for r in substring_dedup.remove_known(docs, known, window=8).collect()]
    grams = {tuple(w[i : i + 8]) for r in known.collect() for w in [(r["text"] or "").encode().split()] for i in range(len(w) - 7)}
    want = []
    for r in docs.collect():
        w = (r["text"] or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - 7):
            if tuple(w[i : i + 8]) in grams:
                gone[i : i + 8] = [True] * 8
        want.append((r["doc_id"], len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    assert key(got) == key(want) and any(x[2] for x in want)
    odd = spark.createDataFrame([(None, None, 1), (1, "", 2), (2, "a b c", 3), (2, "a b c", 3), (3, "x a b c " + "y " * 300_000, 4)], "doc_id long, text string, words int")
    few = spark.createDataFrame([("b c",), (None,), ("",)], "text string")
    assert [r["n_removed"] for r in substring_dedup.remove_known(odd, few, window=2).orderBy("doc_id", "n_words").collect()] == [0, 0, 2, 2, 2]
    assert substring_dedup.remove_known(odd.limit(0), few, window=2).count() == 0
    assert sum(r["n_removed"] for r in substring_dedup.remove_known(odd, few.limit(0), window=2).collect()) == 0
    with pytest.raises(ValueError, match="bytes"):
        substring_dedup.remove_known(odd, docs, window=8, max_bytes=1000)


LONG = [(1, "w" * 100_000, "en", "s"), (2, "word " * 120_000, "en", "s"), (3, " ".join(f"w{i % 977}" for i in range(100_000)), "de", "s"), (4, "short text", "de", "s")]


@pytest.mark.parametrize(
    "run",
    [
        lambda d: sharding.shard_documents(d),
        lambda d: substring_dedup.remove_repeats(d),
        lambda d: packing.pack_documents(d, queries.vocabulary("byte_bpe_50k.tiktoken")).groupBy("doc_id").agg(F.sum("length").alias("n")),
        lambda d: language_id.detect_language(d, language_id.fit_language_model(d)),
        lambda d: quality_model.grade_documents(d, None),
        lambda d: jaccard_join.near_duplicates(d),
        lambda d: quality_rules.judge_quality(d),
        lambda d: piece_codec.encode_documents(d, queries.vocabulary("piece_bpe_32k.model")),
    ],
    ids=["op1", "op2", "op3", "op4", "op6", "op8", "op9", "op10"],
)
def test_very_long_texts(spark, run):
    df = spark.createDataFrame(LONG, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r.asDict() for r in run(df).collect()}
    assert set(got) == {1, 2, 3, 4}
    words = {1: 1, 2: 120_000, 3: 100_000, 4: 2}
    for i, r in got.items():
        if "n_words" in r:
            assert r["n_words"] == words[i]
        if "n_shingles" in r:
            assert r["n_shingles"] == {1: 1, 2: 1, 3: 977, 4: 1}[i]
        if "n_removed" in r:
            assert r["n_removed"] == {1: 0, 2: 120_000, 3: 100_000, 4: 0}[i]
