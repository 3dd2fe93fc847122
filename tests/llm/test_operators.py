import hashlib
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from convmatch.llm import ann, jaccard_join, language_id, license_scan, packing, piece_codec, quality_model, quality_rules, queries, sharding, substring_dedup
from convmatch.llm.common import components, table, written

from . import brute

SCHEMA = "n_words string, doc_id long, text string, lang string, source string, shard string, _id string, label int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(200)) for _ in range(n))


def edge_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    long = prose(1, 6000)
    near = prose(2, 300).split()
    rows = [
        (1, long, "en", "a"), (2, long, "en", "a"), (2, long, "en", "a"), (3, None, "en", "a"), (4, "", None, "b"),
        (5, " \t\n", "fr", None), (None, long, "en", None), (None, None, None, None), (6, "one two", "en", "a"), (7, "ONE two", "de", "a"),
        (8, "one two three four", "en", "a"), (9, "word " * 500, "en", "a"), (10, " ".join(near), "en", "b"),
        (11, " ".join(near[:150] + ["x"] + near[151:]), "en", "b"), (12, " ".join(near[:290]), "fr", "b"), (13, "été　déjà ñandú", "fr", "b"),
        (14, prose(3, 40) + "\n" + prose(4, 60), "en", "c"), (15, prose(5, 10) + " " + prose(4, 60), "en", "c"), (-16, "line a\nline a\n\nline b", "en", "c"),
        (17, "42 17 %%% ###", "en", "c"), (18, "a b c d e f g", "en", "d"), (19, "a b c d e f g h", "en", "d"), (20, "<s> ▁ 中文 🙂 \x00 x  y ", "en", "d"),
    ]
    return [("x", d, t, lang, s, "y", "z", 0) for d, t, lang, s in rows]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, sf, "documents")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("which", ["docs", "edges"])
def test_sharding(which, request):
    df = request.getfixturevalue(which)
    for per_block in (100_000, 3):
        got = sharding.shard_documents(df, 16, per_block).collect()
        want = [(d, brute.crc(t), brute.jump(d or 0, 16), brute.jump(d or 0, 17)) for d, t in pairs(df)]
        assert key((r["doc_id"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in got) == key(want)
        slots = defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
            assert r["grown_shard"] in (r["shard"], 16) and r["law"] == "key"
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("which,hot", [("docs", 4000), ("docs", 2), ("edges", 4000), ("edges", 2)])
def test_substring_dedup(which, hot, request):
    df = request.getfixturevalue(which)
    got = [tuple(r) for r in substring_dedup.remove_repeats(df, 35, hot=hot).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert key(got) == key(brute.repeats(pairs(df), 35))


def test_suffix_automaton_counts():
    r = random.Random(5)
    for _ in range(60):
        seqs = [([r.choice("ab") for _ in range(r.randrange(1, 14))], r.randrange(1, 4)) for _ in range(4)]
        a = substring_dedup.SuffixAutomaton()
        for s, n in seqs:
            a.add(s, n)
        a.close()
        for k in (1, 2, 3):
            count = Counter()
            for s, n in seqs:
                for i in range(len(s) - k + 1):
                    count[tuple(s[i : i + k])] += n
            for s, _ in seqs:
                assert {(e, n) for e, n in a.matches(s, k)} == {(i + k, count[tuple(s[i : i + k])]) for i in range(len(s) - k + 1)}


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
@pytest.mark.parametrize("which", ["docs", "edges"])
def test_near_duplicates(which, k, percent, request):
    df = request.getfixturevalue(which)
    got = [tuple(r) for r in jaccard_join.near_duplicates(df, k, percent).select("doc_id", "n_shingles", "component_id").collect()]
    assert key(got) == key(brute.groups(pairs(df), k, percent))


def test_near_duplicates_in_long_lists(spark):
    """Families whose members are near each other but not their centre, in lists over ``short``."""
    r = random.Random(9)
    rows = []
    for fam in range(3):
        base = prose(100 + fam, 120).split()
        for i in range(40):
            w = list(base)
            for _ in range(r.randrange(0, 8)):
                w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
            if i % 5 == 0:
                w[r.randrange(len(w))] = "other"
                rows.append((len(rows), " ".join(w)))
    rows += [(1000 + i, prose(500 + i, 8)) for i in range(30)] + [(1100 + i, prose(500 + i, 8) + " end") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    members, links = jaccard_join.ngram_links(df, 4, 85, short=5, max_heavy=10)
    group = components(links, spark)
    got = members.join(group, F.col("doc_id") == F.col("node"), "left").select("doc_id", "_n", F.coalesce("component", "doc_id")).collect()
    assert key(map(tuple, got)) == key(brute.groups(rows, 4, 85))


def test_packing(spark, docs, edges):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    for df in (docs, edges):
        got = packing.pack_documents(df, queries.vocabulary("byte_bpe_50k.tiktoken"), 2048, 0, with_ids=True).collect()
        total = 0
        want = Counter()
        for d, t in pairs(df):
            ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
            total += len(ids)
            want[d, hashlib.md5(np.array(ids, dtype="<u4").tobytes()).hexdigest()] += 1
        bins = defaultdict(list)
        parts = defaultdict(list)
        for r in got:
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
            parts[r["doc_id"]].append(r)
            assert r["length"] == len(r["ids"]) <= 2048
        for b in bins.values():
            at = 0
            for o, n in sorted(b):
                assert o == at
                at += n
            assert at <= 2048
        have = Counter()
        for d, ps in parts.items():
            if sum(c for (x, _), c in want.items() if x == d) == 1:
                ps.sort(key=lambda r: r["piece"])
                have[d, hashlib.md5(np.array(sum((p["ids"] for p in ps), []), dtype="<u4").tobytes()).hexdigest()] += 1
        assert all(want[x] == c for x, c in have.items())
        assert len(bins) <= math.ceil(total / 2048) * 1.03 + 1


@pytest.mark.parametrize("choose", ["norm", "dot"])
def test_plan_respects_every_capacity(choose):
    r = random.Random(3)
    counts = {n: r.randrange(1, 40) for n in r.sample(range(1, 200), 60)}
    runs = packing.plan_bins(counts, 200, 6, 12_000 + 28_000, (1.0, 0.5, 0.25), choose)
    bins = defaultdict(list)
    seen = Counter()
    for length, _, items, first, per_bin, at in runs:
        seen[length] += items
        for i in range(items):
            bins[first + i // per_bin].append((at + i % per_bin * length, length))
    assert seen == Counter(counts)
    for b in bins.values():
        assert len(b) <= 6 and sum(n for _, n in b) <= 200 and sum(n * n for _, n in b) <= 40_000
        assert [o for o, _ in sorted(b)] == list(np.cumsum([0] + [n for _, n in sorted(b)])[:-1])


def test_language_id(spark, docs, edges, empty):
    model = language_id.fit_language_model(docs)
    got = language_id.detect_language(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert held and sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    for r, (d, t) in zip(sorted(language_id.detect_language(edges, model).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)), sorted(pairs(edges), key=lambda r: (r[0] is None, r[0] or 0))):
        if r["doc_id"] in (3, 4, 5, 17):
            assert r["lang_pred"] == "und" and r["score"] == 0
    none = language_id.fit_language_model(empty)
    assert {r["lang_pred"] for r in language_id.detect_language(edges, none).collect()} == {"und"}
    for n in (1, 2, 3, 5, 9, 20):
        code = language_id.codewords(n)
        assert len({tuple(c) for c in code.tolist()}) == n
    assert language_id.keep_known_languages(edges, model).columns == edges.columns


def test_language_id_with_many_languages(spark):
    rows = [(i, prose(i, 30), "rare%03d" % i) for i in range(1100)]
    rows += [(2000 + i, prose(5000 + i, 30) if i % 2 else "der die das und nicht mit auf ist ein " * 3 + prose(i, 2), "en" if i % 2 else "de") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit_language_model(df, sample_rows=500)
    want = {r["lang"] for r in df.where(~language_id.held_out()).select("lang").distinct().collect()}
    assert set(model.languages) == want and len(want) > 600
    x = np.random.default_rng(1).normal(size=(3, language_id._DIM)) / 50
    f = np.hstack([x, np.ones((3, 1))]) @ model.weights
    assert np.allclose(model.losses(x), (np.maximum(0, 1 - f[:, None] * model.code[None]) ** 2 * model.bit_weight[None]).sum(2))
    assert language_id.detect_language(df, model).count() == len(rows)


def test_license_scan_against_sql(spark, sf, edges, empty):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(license_scan.oracle()).fetchall()
    got = [tuple(r) for r in license_scan.scan_licenses(table(spark, sf, "documents")).select("doc_id", "license", "n_units", "n_windows", "best_dice").collect()]
    assert key(got) == key(want) and got
    assert license_scan.scan_licenses(edges).collect() == []
    df = spark.createDataFrame([(1, "x\nReleased under the MIT license\nReleased  under the MIT-License!"), (2, "MIT License.")], "doc_id long, text string")
    assert [tuple(r) for r in license_scan.scan_licenses(df).collect()] == [(1, "MIT", 3, 2, 1.0)]  # two lines and the whole text
    # full texts: as a file, as a paragraph among others, with another name and year, and cut in half
    text = dict(license_scan.default_templates())
    rows = [(1, text["ISC"].replace("\n", "\r\n")), (2, "My page.\n\n" + text["Zlib"].split("\n\n")[0] + " " + " ".join(text["Zlib"].split("\n\n")[1:]) + "\n\nThe end."), (3, "Copyright 2031 Ann Other\n\n" + text["MIT"]), (4, text["GPL-3.0"][: len(text["GPL-3.0"]) // 2]), (5, text["GPL-2.0"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = license_scan.scan_licenses(df).collect()
    got = {r["doc_id"]: (r["license"], r["best_dice"]) for r in found if r["n_units"]}
    assert not [r for r in found if r["doc_id"] == 4]
    assert {d: x[0] for d, x in got.items()} == {1: "ISC", 2: "Zlib", 3: "MIT", 5: "GPL-2.0"} and min(x[1] for x in got.values()) > 0.9


def test_quality_model(spark, sf, edges):
    sf = sf.replace("0.001", "0.01")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality_model.fit_quality_model(docs, labels)
    assert (np.diff(model.thresholds) > 0).all()
    got = quality_model.grade_documents(docs, model).join(labels, "doc_id").collect()
    clean = [r for r in got if r["quality"] == 1 and r["toxic"] == 0]
    bad = [r for r in got if r["quality"] == 0 or r["toxic"] == 1]
    assert sum(r["kept"] for r in clean) / len(clean) > 0.95
    assert sum(not r["kept"] for r in bad) / len(bad) > 0.7
    assert quality_model.grade_documents(edges, model).count() == edges.count()
    assert quality_model.fit_quality_model(docs, labels.limit(0)) is None
    assert {r["kept"] for r in quality_model.grade_documents(edges, None).collect()} == {True}


def brute_search(rows, every, k):
    live = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    ids, x = np.array([i for i, _ in live]), np.array([v for _, v in live])
    want = {}
    for i, v in live:
        if i % every == 0:
            s = np.multiply(x, v).sum(1)
            order = np.lexsort((ids, -s))
            want[i] = [(int(ids[j]), s[j]) for j in order if ids[j] != i][:k]
    return want


def test_search(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, sf.replace("0.001", "0.01"), "embeddings").collect()]
    rows += [(10_000 + i, rows[20][1]) for i in range(60)]
    rows += [(20_000, None), (20_020, [0.0] * 64), (20_040, [float("nan")] * 64), (20_060, [None] + [1.0] * 63), (None, rows[0][1]), (20_080, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    got = defaultdict(list)
    for r in ann.search(df, 20, 20, block_rows=50).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got[r["query_id"]]) + 1
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = brute_search([(r["vec_id"], r["embedding"]) for r in df.collect()], 20, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    found = sum(len({x for x, _ in v} & {x for x, _ in want[q]}) for q, v in got.items())
    assert found / sum(map(len, want.values())) >= 0.9
    exact = {q: dict(brute_search([(r["vec_id"], r["embedding"]) for r in df.collect()], 20, 10**6)[q]) for q in list(got)[:20]}
    for q in exact:
        assert all(abs(exact[q][v] - s) < 1e-12 for v, s in got[q])
        assert got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))
    few = spark.createDataFrame([(20, [1.0, 2.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.search(few).collect()] == [(20, 1, 1, 1.0), (20, 2, 2, 1.0)]
    assert ann.search(few.limit(0)).collect() == []


@pytest.mark.parametrize("which", ["docs", "edges"])
def test_quality_rules(which, request):
    df = request.getfixturevalue(which)
    got = quality_rules.judge_quality(df).collect()
    have = [tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in got]
    assert key(have) == key((d, *brute.quality(t)) for d, t in pairs(df))
    assert not any(r["kept"] and r["base_failed"] for r in got)
    good = [r for r in got if not r["base_failed"]]
    assert sum(r["kept"] for r in good) / len(good) > 0.8
    kept = quality_rules.keep_good(df)
    assert kept.columns == df.columns and kept.count() == sum(r["kept"] for r in got)


def test_piece_codec(spark, docs, edges):
    import sentencepiece

    path = queries.vocabulary("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for df in (docs, edges):
        want = []
        for d, t in pairs(df):
            ids = sp.encode(t or "", add_bos=True, add_eos=True)
            want.append((d, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
        assert key(map(tuple, piece_codec.encode_documents(df, path).collect())) == key(want)
    codec = piece_codec.codec(path)
    r = random.Random(2)
    for _ in range(1500):
        t = "".join(r.choice("ab eéßñ▁ \n\t<>/s中🙂x1·") for _ in range(r.randrange(40)))
        ids = np.frombuffer(codec.encode(t), dtype="<u4").tolist()
        assert ids == sp.encode(t, add_bos=True, add_eos=True) and codec.decode(codec.encode(t)) == sp.decode(ids)


def test_components_of_long_chains(spark):
    e = [(i, i + 1) for i in range(0, 60)] + [(200, 100), (100, 150), (7, 7)]
    df = spark.createDataFrame(e, "a long, b long")
    got = {r["node"]: r["component"] for r in components(df, spark).collect()}
    assert {got[i] for i in range(1, 61)} == {0} and got[200] == got[150] == 100


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    path = queries.vocabulary("piece_bpe_32k.model")
    assert sharding.shard_documents(empty).count() == 0
    assert substring_dedup.remove_repeats(empty).count() == 0
    assert packing.pack_documents(empty, queries.vocabulary("byte_bpe_50k.tiktoken")).count() == 0
    assert license_scan.scan_licenses(empty).count() == 0
    assert quality_model.grade_documents(empty, quality_model.fit_quality_model(empty, labels)).count() == 0
    assert jaccard_join.near_duplicates(empty).count() == 0
    assert quality_rules.judge_quality(empty).count() == 0
    assert piece_codec.encode_documents(empty, path).count() == 0
