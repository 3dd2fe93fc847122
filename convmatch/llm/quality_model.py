"""Ordinal regression of graded text quality: a cumulative-link model on hashed words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns
from .wordhash import mix, word_hashes, word_spans

_DIM = 1 << 15
#: Character classes of the first and last byte of a word: other, letter, capital, digit, mark.
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[97:123] = _CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
for _i, _c in enumerate(b"#*$%&|<>!"):
    _CLASS[_c] = 4 + _i
_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[97:123] = _LETTERS[65:91] = _LETTERS[128:] = True


def text_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a whole text's features.

    Every distinct word without its marks, in lower case, is present or not (value 1); word
    shapes (classes of the first and last byte), doubled words and capitals count by share.
    """
    raw = (text or "").encode()
    buf = np.frombuffer(raw, dtype=np.uint8)
    if len(buf) == 0:
        return np.array([0]), np.array([1.0])
    starts, ends = word_spans(buf)
    if len(starts) == 0:
        return np.array([0]), np.array([1.0])
    plain = np.where(_LETTERS[buf], buf, 32).astype(np.uint8).tobytes()
    hashed = word_hashes(plain, lower=True)
    words = np.unique((mix(hashed) >> np.uint64(20)) % np.uint64(_DIM - 512)).astype(np.int64) + 512
    shape = _CLASS[buf[starts]] * 16 + _CLASS[buf[ends - 1]]
    share = np.bincount(shape, minlength=256) / len(starts)
    exact = word_hashes(raw)
    doubled = float((exact[1:] == exact[:-1]).mean()) if len(exact) > 1 else 0.0
    capital = float((_CLASS[buf] == 2).sum() / max(1, _LETTERS[buf].sum()))
    at = np.flatnonzero(share)
    idx = np.concatenate([[0, 260, 261], 1 + at, words])
    val = np.concatenate([[1.0, 10 * doubled, 10 * capital], 10 * share[at], np.ones(len(words))])
    return idx, val


@dataclass
class OrdinalModel:
    """P(grade <= k) = logistic(threshold_k - w . x), one weight vector for all grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for every score and k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None] - score[:, None], -40, 40)))

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        for i, t in enumerate(texts):
            idx, val = text_features(t)
            out[i] = self.weights[idx] @ val
        return out


def train_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], grade: np.ndarray, grades: int, steps: int = 400, penalty: float = 2e-4) -> OrdinalModel:
    """Full-batch Adam on the likelihood of the cumulative-link model.

    Only features whose mean grade differs clearly from the rest (|z| >= 4) get a weight;
    thresholds are kept in order as a first value and positive gaps.
    """
    n = len(rows)
    idx = np.concatenate([r[0] for r in rows])
    val = np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(n), [len(r[0]) for r in rows])
    balance = n / grades / np.bincount(grade, minlength=grades).clip(1)[grade]
    low = (grade[:, None] > np.arange(grades - 1)[None]).astype(float)
    z = np.zeros(_DIM)
    have = np.bincount(idx, val > 0, minlength=_DIM)
    for k in range(grades - 1):
        p = low[:, k].mean()
        seen = np.bincount(idx, (val > 0) * low[row, k], minlength=_DIM)
        z = np.maximum(z, np.abs(seen - have * p) / np.sqrt(have * p * (1 - p) + 1e-9) * (have >= 5))
    use = z >= 4
    use[:512] = True
    keep = use[idx]
    idx, val, row = idx[keep], val[keep], row[keep]
    w, theta = np.zeros(_DIM), np.concatenate([[-1.0], np.zeros(grades - 2)])
    m, v = [np.zeros(_DIM), np.zeros(grades - 1)], [np.zeros(_DIM), np.zeros(grades - 1)]
    for step in range(1, steps + 1):
        cut = np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])]))
        s = np.bincount(row, w[idx] * val, minlength=n)
        below = 1 / (1 + np.exp(np.clip(s[:, None] - cut[None], -40, 40)))  # P(grade <= k)
        cdf = np.hstack([np.zeros((n, 1)), below, np.ones((n, 1))])
        slope = np.hstack([np.zeros((n, 1)), below * (1 - below), np.zeros((n, 1))])
        i = np.arange(n)
        p = (cdf[i, grade + 1] - cdf[i, grade]).clip(1e-9)
        ds = balance * (slope[i, grade + 1] - slope[i, grade]) / p / n  # of minus log p
        gw = np.bincount(idx, ds[row] * val, minlength=_DIM) + penalty * w
        gc = np.array([(balance * (((grade == k + 1) - (grade == k).astype(float)) * slope[:, k + 1]) / p).sum() / n for k in range(grades - 1)])
        back = gc[::-1].cumsum()[::-1]
        gt = back * np.concatenate([[1.0], np.exp(theta[1:])])
        for j, (x, g) in enumerate(((w, gw), (theta, gt))):
            m[j] = 0.9 * m[j] + 0.1 * g
            v[j] = 0.999 * v[j] + 0.001 * g * g
            x -= 0.05 * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
    return OrdinalModel(w, np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])])))


def fit_quality_model(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000) -> OrdinalModel | None:
    """Fit on at most ``max_rows`` labelled documents, taken by a hash of doc_id.

    Grades: 0 toxic, 1 not toxic but of low quality, 2 of good quality.  Labels that miss a
    value are left out.  Texts stay on the executors; their features reach the driver: ``max_rows``
    rows of no more features than a text has different words.  Returns None if fewer than two
    labelled documents are there, as in empty tables.  Null and empty texts have no word; rows that
    repeat a doc_id count once each; very long texts are hashed whole; other columns of
    either table, whatever their names, are not read.
    """
    graded = columns(labels, "doc_id", "quality", "toxic").where("doc_id is not null and quality is not null and toxic is not null")
    graded = graded.groupBy("doc_id").agg(F.min(F.when(F.col("toxic") > 0, 0).when(F.col("quality") <= 0, 1).otherwise(2)).alias("grade"))
    every = max(1, graded.count() // max_rows)
    h = F.xxhash64("doc_id")
    graded = graded.where(F.pmod(h, F.lit(every)) == 0)
    sample = columns(docs, "doc_id", "text").where(F.pmod(h, F.lit(every)) == 0).join(graded, "doc_id").select("doc_id", "grade", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [text_features(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([g[0].astype(np.int32).tobytes() for g in got], pa.binary()), pa.array([g[1].astype(np.float32).tobytes() for g in got], pa.binary())],
                ["doc_id", "grade", "i", "v"],
            )

    got = sample.mapInArrow(features, "doc_id long, grade int, i binary, v binary").orderBy(h, "doc_id").limit(max_rows).toArrow().to_pydict()
    if len(got["grade"]) < 2:
        return None
    rows = [(np.frombuffer(i, dtype=np.int32).astype(np.int64), np.frombuffer(v, dtype=np.float32).astype(float)) for i, v in zip(got["i"], got["v"])]
    return train_ordinal(rows, np.array(got["grade"]), 3)


def grade_documents(docs: DataFrame, model: OrdinalModel | None, least: float = 0.5) -> DataFrame:
    """doc_id, expected_grade (0 to 2), tail_prob = P(grade 2), not_toxic_prob, kept.

    ``kept`` if the tail probability is ``least`` or more.  Null and empty texts have no
    word and get the model's base rate; without a model grades are null and all is kept.
    Repeated rows are graded alike, null doc_ids too; very long texts are hashed whole; other
    columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if model is None:
                none = pa.nulls(n, pa.float64())
                cols = [none, none, none, pa.array([True] * n, pa.bool_())]
            else:
                tail = model.tails(model.score(batch.column(1).to_pylist()))
                cols = [pa.array(tail.sum(1)), pa.array(tail[:, -1]), pa.array(tail[:, 0]), pa.array(tail[:, -1] >= least)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", "expected_grade", "tail_prob", "not_toxic_prob", "kept"])

    rows = columns(docs, "doc_id", "text").selectExpr("cast(doc_id as long) doc_id", "text")
    return rows.mapInArrow(run, "doc_id long, expected_grade double, tail_prob double, not_toxic_prob double, kept boolean")
