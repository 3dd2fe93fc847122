"""A training-corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from convmatch.llm import jaccard_join, language_id, packing, quality_rules, substring_dedup
from convmatch.llm.common import table, written
from convmatch.llm.queries import vocabulary


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie far from their language and source go.

    Null, empty and short texts go; null lang or source is a group of its own; repeated rows
    are judged alike; very long texts are measured whole; all columns, whatever their names,
    pass; an empty table gives no rows.
    """
    return quality_rules.keep_good(docs)


def language_id_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not known with a score of 0.5 or more go.

    Null texts and texts without a letter go; if nothing can be learned (no lang, or an empty
    table) all go; repeated rows are judged alike, very long texts read whole; all columns pass.
    """
    return language_id.keep_known_languages(docs, language_id.fit_language_model(docs))


def jaccard_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8.

    The least doc_id stays, of rows that repeat it one; rows with a null doc_id and texts
    without a word stay; very long texts are compared whole; all columns pass; an empty table
    gives no rows.
    """
    return jaccard_join.keep_one_of_each(docs, k=5, percent=80)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that repeat are cut out of the texts.

    Null and short texts stay as they are; repeated rows, which the stage before leaves only
    with null doc_ids, empty each other; a text of any length is cut whole; every row and all
    columns pass; an empty table gives no rows.
    """
    return substring_dedup.drop_repeats(docs, window=35)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts as token pieces in sequences of at most 2048 tokens and 256 pieces.

    Null and empty texts, as those that lost all words before, are one token; null doc_ids and
    repeated rows are packed like others; other columns are dropped; an empty table gives no rows.
    """
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.tiktoken"), 2048, 0, max_docs=256)


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("language_id", language_id_stage),
    ("ngram_jaccard_join", jaccard_join_stage),
    ("substring_dedup", substring_dedup_stage),
    ("best_fit_packing", packing_stage),
]

#: The stages learn, hash and tokenize; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
    return docs
