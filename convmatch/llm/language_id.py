"""Language identification by error-correcting output codes over byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, discard, in_arrow, written

_DIM = 2048
#: Rows that are in double precision at once while fitting and least distances are sought.
_BLOCK = 512
_LETTER = regex.compile(r"\p{L}")
#: Bytes that are no ASCII letter become a blank; bytes of other letters stay.
_KEEP = np.where((np.arange(256) >= 128) | ((np.arange(256) >= 97) & (np.arange(256) <= 122)), np.arange(256), 32).astype(np.uint32)


def ngram_features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed byte bigrams and trigrams of the whole text."""
    b = _KEEP[np.frombuffer(text.lower().encode(), dtype=np.uint8)]
    out = np.zeros(_DIM)
    if len(b) >= 2:
        pair = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA77)
        out += np.bincount((pair ^ (pair >> np.uint32(15))) & np.uint32(_DIM - 1), minlength=_DIM)
        if len(b) >= 3:
            three = pair[:-1] + b[2:] * np.uint32(0xC2B2AE3D)
            out += np.bincount((three ^ (three >> np.uint32(13))) & np.uint32(_DIM - 1), minlength=_DIM)
    total = out.sum()
    return np.sqrt(out / total) if total else out


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """Codewords of +1 and -1: all splits for up to 7 classes, else the best of 50 random codes."""
    if classes < 2:
        return np.ones((classes, 1))
    if classes <= 7:
        rows = np.array([[1 if j >> c & 1 == 0 else -1 for j in range(2 ** classes)] for c in range(classes)])
        keep = [j for j in range(1, 2 ** classes) if rows[0, j] == 1]
        return rows[:, keep].astype(float)

    def nearest(code: np.ndarray) -> float:
        # the least distance of two codewords, in blocks of rows
        least = np.inf
        for i in range(0, classes, _BLOCK):
            d = (length - code[i : i + _BLOCK] @ code.T) / 2
            d[np.arange(len(d)), i + np.arange(len(d))] += length
            least = min(least, d.min())
        return least

    rng, length = np.random.default_rng(seed), int(np.ceil(10 * np.log2(classes)))
    best, far = None, -1.0
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (classes, length))
        near = nearest(code)
        if near > far and (np.abs(code.sum(0)) < classes).all():
            best, far = code, near
    return best


@dataclass
class LanguageModel:
    """Binary classifiers of the codewords' bits and the weights of the decoder."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bit_weight: np.ndarray
    sharpness: float = 6.0
    margin: float = 0.05

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Weighted loss of every codeword: squared hinge of the classifiers' margins."""
        f = np.hstack([x, np.ones((len(x), 1))]) @ self.weights
        plus, minus = (self.bit_weight * (self.code == sign) for sign in (1, -1))
        return np.maximum(0, 1 - f) ** 2 @ plus.T + np.maximum(0, 1 + f) ** 2 @ minus.T

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, score in 0..1 and whether two codewords are about equally near."""
        live = [i for i, t in enumerate(texts) if t and self.languages and _LETTER.search(t)]
        lang, score, ambiguous = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
        if live:
            loss = self.losses(np.array([ngram_features(texts[i]) for i in live]))
            p = np.exp(-self.sharpness * (loss - loss.min(1, keepdims=True)))
            p /= p.sum(1, keepdims=True)
            two = np.sort(loss, axis=1)[:, :2] if loss.shape[1] > 1 else np.array([[0.0, 1.0]] * len(live))
            for j, i in enumerate(live):
                k = int(p[j].argmax())
                lang[i], score[i] = self.languages[k], float(p[j, k])
                ambiguous[i] = bool(two[j, 1] - two[j, 0] < self.margin)
        return lang, score, ambiguous


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def fit_language_model(docs: DataFrame, per_language: int = 1500, sample_rows: int = 60_000, ridge: float = 1e-3) -> LanguageModel:
    """Learn all languages, from about ``per_language`` distinct texts of each.

    With many languages each has about ``sample_rows`` / languages texts, or 20 if that is
    more; a language with fewer distinct texts has them all, and each has one at least.  Rows
    without text, lang or a letter, and held-out rows, are left out; repeated texts count once
    a language; an empty table gives a model of no language; other columns are not read.

    The sample is taken by a hash of the text and written.  Its features stream through one
    task, which keeps their normal equations and returns the solution: neither texts nor
    features reach the driver.
    """
    rows = columns(docs, "doc_id", "text", "lang").where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.select(F.col("lang").cast("string"), "text", F.xxhash64("text").alias("_h"))
    kinds = rows.groupBy("lang").agg(F.approx_count_distinct("_h").alias("n"), F.min("_h").alias("least")).collect()  # a row a language
    languages = sorted(r["lang"] for r in kinds)
    if not languages:
        return LanguageModel([], np.ones((0, 1)), np.zeros((_DIM + 1, 1)), np.ones((0, 1)))
    per_language = min(per_language, max(20, sample_rows // len(languages)))
    # a share of the distinct texts, not of the rows, so that a language of copies is not lost
    share = [(r["lang"], r["least"], min(2**40, int(2**40 * per_language / max(1, r["n"])))) for r in kinds]
    chosen = docs.sparkSession.createDataFrame(share, "lang string, _least long, _cut long")
    sample = rows.join(F.broadcast(chosen) if len(share) <= 100_000 else chosen, "lang").where((F.pmod("_h", F.lit(2**40)) < F.col("_cut")) | (F.col("_h") == F.col("_least")))
    sample = written(sample.groupBy("lang", "_h").agg(F.min("text").alias("text")))
    counts = {r["lang"]: r["n"] for r in sample.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    number = {lang: i for i, lang in enumerate(languages)}
    code = codewords(len(languages))
    total = sum(counts.values())
    weight = np.array([total / len(languages) / counts[lang] for lang in languages])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [ngram_features(t).astype(np.float32).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.binary())], ["lang", "h", "x"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            for lo in range(0, batch.num_rows, _BLOCK):
                part = batch.slice(lo, _BLOCK)
                x = np.frombuffer(b"".join(part.column(2).to_pylist()), dtype=np.float32).reshape(-1, _DIM)
                yield np.hstack([x.astype(float), np.ones((len(x), 1))]), np.array([number[v] for v in part.column(0).to_pylist()])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, target = ridge * total * np.eye(_DIM + 1) / _DIM, np.zeros((_DIM + 1, code.shape[1]))
        for x, y in blocks(batches):
            w = x * weight[y][:, None]
            gram += x.T @ w
            target += w.T @ code[y]
        yield pa.RecordBatch.from_arrays([pa.array([np.linalg.solve(gram, target).tobytes()], pa.binary())], ["w"])

    shown = in_arrow(sample, features, "lang string, h long, x binary")
    # in one order, so that equal samples give equal models
    one = in_arrow(shown.repartition(1).sortWithinPartitions("lang", "h"), solve, "w binary")
    weights = np.frombuffer(one.collect()[0]["w"]).reshape(_DIM + 1, -1)

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for x, y in blocks(features(batches)):
            hit = (x @ weights) * code[y] > 0
            for c in np.unique(y):
                seen[int(c)] = seen.get(int(c), 0) + hit[y == c].sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array([v.tolist() for v in seen.values()], pa.list_(pa.int64()))], ["c", "hits"])

    # a bit counts for a class by the share of the class's own texts on which it is right
    bit = np.full(code.shape, 1e-6)
    for r in in_arrow(sample, right, "c long, hits array<long>").toLocalIterator():
        bit[r["c"]] += np.array(r["hits"]) / counts[languages[r["c"]]]
    discard(sample)
    return LanguageModel(languages, code, weights, bit / bit.sum(1, keepdims=True))


def detect_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for every row, from its whole text.

    Null text, and text without a letter, gives ``und`` with score 0; so does every text if
    the model has learned no language.  Repeated rows give repeated results, an empty table
    none; null doc_ids are not held out; other columns are not read; texts of any length are
    read whole.  No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            lang, score, ambiguous = [], [], []
            for i in range(0, len(texts), 256):
                for have, new in zip((lang, score, ambiguous), model.predict(texts[i : i + 256])):
                    have.extend(new)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ambiguous, pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
            )

    rows = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return in_arrow(rows, run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def keep_known_languages(docs: DataFrame, model: LanguageModel, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known with score ``least`` or more.

    A row stays with its own columns, whatever their names, so nulls and repeated rows need
    no key.  Null text and text without a letter goes; an empty table gives no rows.
    """
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            keep = []
            for i in range(0, len(texts), 256):
                lang, score, _ = model.predict(texts[i : i + 256])
                keep += [name != "und" and s >= least for name, s in zip(lang, score)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return in_arrow(docs.select(*[F.col(f"`{n}`") for n in names]), run, docs.schema)
