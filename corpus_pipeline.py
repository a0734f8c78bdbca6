"""The corpus pipeline: quality rules, near-duplicate join, repeated passages, best-fit packing.

Each stage takes what the one before it kept and, but for the last, returns the
columns of ``documents``.  Null and empty texts have no words and go with the
quality rules; null sources, languages, counts and ids go through as they are.
Equal rows shrink to one in the Jaccard stage, other columns stay, and an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparrowgrid.llm import jaccard, packing, quality, repeats
from sparrowgrid.llm.common import settle, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failing lines."""
    settle(spark)
    return quality.filter_documents(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group linked by five-word shingles at 0.8 or more."""
    settle(spark)
    return jaccard.keep_one(docs, n=5, num=80, den=100)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 50 bytes that a smaller document has."""
    settle(spark)
    return repeats.clean_documents(docs, length=50)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins of 2,048 words."""
    settle(spark)
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard", ngram_jaccard),
    ("suffix_dedup", suffix_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: The stages can't be said in SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
