"""A corpus pipeline: language identification, exact and near deduplication,
mixing of sources, packing into training sequences.

Every stage reads all rows that the one before kept. The stages up to mixing
return the columns of ``documents``; packing returns the pieces of sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lineseek.llm.exact_dedup import drop_exact_duplicates
from lineseek.llm.language import fit_labelled, keep_identified
from lineseek.llm.mixing import BUDGET, sample_mixed
from lineseek.llm.near_dup import drop_near_duplicates
from lineseek.llm.packing import pack_documents
from lineseek.llm.work import materialise

LEAST_LANGUAGE_SCORE = 0.5

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages labelled in ``docs``; those without a letter,
    or with no language at a probability of half or more, go."""
    return keep_identified(docs, fit_labelled(docs), least_score=LEAST_LANGUAGE_SCORE)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text (A-Z lower-cased): the largest doc_id."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 on five-word shingles: the smallest doc_id."""
    return drop_near_duplicates(docs, words=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with half of the tokens, drawn so that sources, languages and topics meet their
    tempered shares; values with too few tokens for theirs are kept whole."""
    return sample_mixed(docs, budget=BUDGET)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL can't express language identification; tests/llm compares with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
