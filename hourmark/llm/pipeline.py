"""Stages of the corpus pipeline: quality rules, exact and near de-duplication, repeated passages, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows of ``docs``. A null
text counts as an empty one, rows that repeat another share its fate, columns
beyond those of ``documents`` pass through whatever they are called, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hourmark.llm import exactdedup, nearcopies, packing, quality, suffixes
from hourmark.llm.common import shared_path, table


def good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality rules reject.

    A null or empty text has no words and goes; null ids and ties are judged by their text alone.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays.

    That with the most code points, then the smallest doc_id; one without a doc_id
    only if no other has its text. Rows equal in doc_id and text stay together.
    """
    return exactdedup.keep_first(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingle sets 0.8 or more alike) stays: that with the smallest id.

    Texts of fewer than five words are one shingle, empty ones link with each other;
    a row without a doc_id stays if it has no near copy with one.
    """
    return nearcopies.keep_one(docs)


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes and passages of over 50 words that occur elsewhere too are cut out of the texts.

    Every row stays, also one left without text; null texts stay null.
    """
    return suffixes.without_repeats(docs, words=51)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining texts as pieces of token sequences; a null or empty text is its end token alone."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", good_text),
    ("exact dedup", without_copies),
    ("SimHash near-dedup", without_near_copies),
    ("suffix-array dedup", without_passages),
    ("packing", packed),
]

#: SQL states neither the quality model nor the tokens of the packed result.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again.

    Empty tables pass through all stages. Written results stay, so a lost executor repeats one stage at most.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = shared_path(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
