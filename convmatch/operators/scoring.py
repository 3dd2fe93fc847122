"""Batch scoring through pluggable functions, and its costs."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], list[list[float]]]
Scorer = Callable[[list[str]], list[str]]


def embed(df: DataFrame, text: str, embedder: Embedder, batch: int = 100, tries: int = 3) -> DataFrame:
    """Add ``embedding`` and ``error``: batches are tried again; a failed one gives nulls."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out, err = [], []
            for i in range(0, len(pdf), batch):
                part = pdf[text].iloc[i : i + batch].tolist()
                got, why = [None] * len(part), None
                for _ in range(tries):
                    try:
                        got, why = embedder(part), None
                        break
                    except Exception as e:  # the service's failure is data here
                        why = str(e)
                out += got
                err += [why] * len(part)
            yield pdf.assign(embedding=out, error=err)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, kinds + ", embedding array<double>, error string")


def tfidf_embedding(df: DataFrame, text: str, dim: int = 256) -> DataFrame:
    """Built-in embedder: hashed words, inverse document frequency, unit length."""
    d = RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"\W+").transform(df.withColumn(text, F.coalesce(text, F.lit(""))))
    d = HashingTF(inputCol="_w", outputCol="_tf", numFeatures=dim).transform(d)
    d = IDF(inputCol="_tf", outputCol="_idf").fit(d).transform(d)
    d = Normalizer(inputCol="_idf", outputCol="_n").transform(d)
    return d.withColumn("embedding", vector_to_array("_n")).drop("_w", "_tf", "_idf", "_n")


def hashed_words(texts: list[str], dim: int = 64) -> list[list[float]]:
    """Built-in embedder of single texts: signed counts of hashed words, unit length."""
    out = []
    for text in texts:
        v = [0.0] * dim
        for word in re.findall(r"\w+", text.lower()):
            h = zlib.crc32(word.encode())
            v[h % dim] += 1.0 if h & 0x80000000 else -1.0
        n = sum(x * x for x in v) ** 0.5
        out.append([x / n for x in v] if n else [1.0] + v[1:])
    return out


def complete(df: DataFrame, prompt: str, scorer: Scorer, answer: str = "answer", error: str | None = None, batch: int = 20) -> DataFrame:
    """Add ``answer`` (and ``error``, the reason of a failed call), row by row beside its key.

    Prompts go to the scorer in batches; a batch that fails is asked prompt by prompt, so that
    one failed call is one null.  A null prompt is not asked.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out, why = pd.Series(None, index=range(len(pdf)), dtype=object), pd.Series(None, index=range(len(pdf)), dtype=object)
            asked = [i for i, p in enumerate(pdf[prompt]) if p is not None]
            for lo in range(0, len(asked), batch):
                some = asked[lo : lo + batch]
                try:
                    got = scorer([pdf[prompt].iloc[i] for i in some])
                    if len(got) != len(some):
                        raise ValueError("the scorer gave another number of answers")
                    out[some] = got
                except Exception:
                    for i in some:
                        try:
                            out[i] = scorer([pdf[prompt].iloc[i]])[0]
                        except Exception as e:  # the service's failure is data here
                            why[i] = str(e)
            pdf = pdf.assign(**{answer: out.to_numpy()})
            yield pdf.assign(**{error: why.to_numpy()}) if error else pdf

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{kinds}, {answer} string" + (f", {error} string" if error else ""))


def complete_sequence(df: DataFrame, prompts: list[Column | Callable[[Column], Column]], scorer: Scorer) -> DataFrame:
    """Steps of a prompt sequence; a step may be a function of the previous answer.

    Adds ``completions``, the answers in order; empty if any step gave none.
    """
    names = []
    for i, p in enumerate(prompts):
        col = p(F.col(names[-1])) if callable(p) and not isinstance(p, Column) else p
        df = complete(df.withColumn("_p", col), "_p", scorer, f"_a{i}").drop("_p")
        names.append(f"_a{i}")
    whole = F.forall(F.array(*names), lambda a: a.isNotNull())
    return df.withColumn("completions", F.when(whole, F.array(*names)).otherwise(F.array().cast("array<string>"))).drop(*names)


def context(turns: str, with_memory: Column) -> Column:
    """All turns, or only the last one."""
    return F.when(with_memory, F.col(turns)).otherwise(F.slice(turns, -1, 1))


def reusable(rows: DataFrame, stored: DataFrame, key: str, content: str) -> DataFrame:
    """Add ``reuse``: whether the stored row of the key has the same content."""
    old = stored.select(key, F.col(content).alias("_old"))
    return rows.join(old, key, "left").withColumn("reuse", F.coalesce(F.col("_old") == F.col(content), F.lit(False))).drop("_old")


def lead_sentence(prompts: list[str]) -> list[str]:
    """Built-in summariser: first sentence of the last block."""
    return [re.split(r"(?<=[.!?])\s", p.split("\n\n")[-1].strip())[0] for p in prompts]


def first_ids_path(prompts: list[str]) -> list[str]:
    """Built-in path scorer: first id of either side is common, the next ones unique."""
    out = []
    for p in prompts:
        one, _, two = p.partition("\n\nUSER 2\n")
        a, b = (re.findall(r"^ID: (\d+)$", x, re.M) for x in (one, two))
        out.append(f'{{"path_title": "Shared interest", "common_indices": [{", ".join(a[:1] + b[:1])}], "user1_unique_indices": [{", ".join(a[1:3])}], "user2_unique_indices": [{", ".join(b[1:3])}], "common_background": ""}}')
    return out


def call_costs(log: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of each model's calls: tokens in and out at prices per million."""
    d = log.join(prices, "model")
    return d.groupBy("model").agg(F.sum(F.col("input_tokens") * F.col("input_cpm") / 1e6 + F.col("output_tokens") * F.col("output_cpm") / 1e6).alias("cost"))
