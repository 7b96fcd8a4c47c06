"""Registered queries: each operator over its whole table, in the form of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lineseek.llm.chat import maximal_conversations
from lineseek.llm.divergence import source_divergence
from lineseek.llm.exact_dedup import exact_duplicates
from lineseek.llm.language import identify_held_out
from lineseek.llm.mixing import BUDGET, mix
from lineseek.llm.near_dup import near_duplicates
from lineseek.llm.packing import pack_documents
from lineseek.llm.periodic import periodic_runs
from lineseek.llm.pii import find_personal_data
from lineseek.llm.suffix_dedup import remove_repeats
from lineseek.llm.token_files import token_digests, write_token_files
from lineseek.llm.topk import top_k
from lineseek.llm.url_rules import DEFAULT_PATTERNS, judge_urls, site_rule
from lineseek.llm.work import new_path

#: The site rules that every URL is judged by.
SITE_RULES = (
    site_rule("allow", "org/"),
    site_rule("block", "example.org/es/"),
    site_rule("block", "example.org/en/1"),
    site_rule("allow", "com/fr/"),
    site_rule("block", "com/de/"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op2_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maximal_conversations(table(spark, sf_dir, "conversations"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), [*SITE_RULES, *DEFAULT_PATTERNS])


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), keep_encoder=True)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_held_out(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return token_digests(spark, path)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), budget=BUDGET)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), plant=True)


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_chat_snapshots": op2_chat_snapshots,
    "op3_url_filters": op3_url_filters,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_exact_top_k": op7_exact_top_k,
    "op8_language_id": op8_language_id,
    "op9_token_files": op9_token_files,
    "op10_mixing": op10_mixing,
    "op11_source_divergence": op11_source_divergence,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_pii": op13_pii,
}
