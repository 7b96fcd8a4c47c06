"""The search index as Parquet tables in one folder.

* ``entries``   id, title, content, processed texts, original entry; split by id range
* ``signals``   id, title, content_vec, title_vec: what every search scans
* ``postings``  doc_id, term, tf, doc_len; split by a hash of the term
* ``terms``     term, df, idf; split the same way
* ``metadata``  one row per build; the latest names the folder of the other tables

A build writes its tables to a folder of its own and then adds its metadata row.
Until that row is there, and if a build fails, searches use the build before. Builds
that were replaced stay, so a search that was described earlier can still be
run; ``remove_old_builds`` takes them away once nothing reads them any more.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lineseek.functions.text import split_words
from lineseek.operators.keyword import document_frequency, postings, term_bucket
from lineseek.session import remove

DOCS_PER_TERM_BUCKET = 100_000
DOCS_PER_ID_BLOCK = 100_000
MAX_PARTITIONS = 4096
TABLES = ("entries", "signals", "postings", "terms")


class Index(NamedTuple):
    """Tables of an index plus the corpus numbers scoring needs.

    ``term_buckets`` and ``docs_per_block`` are None for tables not read from disk.
    """

    entries: DataFrame
    signals: DataFrame
    postings: DataFrame
    terms: DataFrame
    n_docs: Column
    avg_doc_len: Column
    term_buckets: int | None = None
    docs_per_block: int | None = None


def _write(df: DataFrame, output_dir: str, table: str, *partition_by: str) -> DataFrame:
    writer = df.write.mode("overwrite")
    path = f"{output_dir}/{table}"
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    columns = [field for field in df.schema if field.name not in partition_by]
    columns += [df.schema[name] for name in partition_by]
    return df.sparkSession.read.schema(StructType(columns)).parquet(path)


def write_entries(entries: DataFrame, output_dir: str, n_docs: int) -> DataFrame:
    """Ids rise within each input block, so a task writes to one or two id ranges
    and nothing is shuffled; a search reads only the ranges of its results."""
    blocked = entries.withColumn("id_block", id_block(F.col("id"), docs_per_block(n_docs)))
    return _write(blocked, output_dir, "entries", "id_block")


def write_signals(signals: DataFrame, output_dir: str) -> DataFrame:
    return _write(signals, output_dir, "signals")


def write_postings(entries: DataFrame, output_dir: str, n_docs: int) -> DataFrame:
    """Postings of stored entries, clustered by term.

    The one shuffle gathers term buckets into tasks of even size: adaptive
    execution splits a bucket, even one term, by the bytes it turns out to hold.
    A collection of a single bucket is too small for that to keep the cores busy and
    its terms are dealt to them by hash; one of them has few documents at most.
    Sorting by term inside each file lets Parquet encode and skip it well.
    """
    buckets = term_buckets(n_docs)
    words = entries.select(
        "id",
        split_words(F.col("processed_content")).alias("content_tokens"),
        split_words(F.col("processed_title")).alias("title_tokens"),
    )
    placed = postings(words).withColumn("term_bucket", term_bucket(F.col("term"), buckets))
    cores = entries.sparkSession.sparkContext.defaultParallelism
    spread = placed.repartition(cores, "term") if buckets == 1 else placed.hint("rebalance", "term_bucket")
    spread = spread.sortWithinPartitions("term_bucket", "term", "doc_id")
    return _write(spread, output_dir, "postings", "term_bucket")


def write_terms(stored_postings: DataFrame, output_dir: str, n_docs: int) -> DataFrame:
    counted = document_frequency(stored_postings, F.lit(n_docs))
    placed = counted.withColumn("term_bucket", term_bucket(F.col("term"), term_buckets(n_docs)))
    return _write(placed, output_dir, "terms", "term_bucket")


def new_build(output_dir: str) -> str:
    """Folder for the tables of one build."""
    return f"{output_dir}/build-{uuid.uuid4().hex}"


def publish(
    spark: SparkSession, output_dir: str, build_dir: str, schemas: dict[str, StructType], *, source_file: str,
    content_field: str, title_field: str, model: str, title_boost: bool, entry_count: int, avg_doc_len: float,
) -> None:
    """Adds the metadata row that makes a finished build the one in force."""
    row = spark.range(1).select(
        F.current_timestamp().alias("created_at"),
        F.lit(source_file).alias("source_file"),
        F.lit(content_field).alias("content_field"),
        F.lit(title_field).alias("title_field"),
        F.lit(model).alias("model"),
        F.lit(title_boost).alias("title_boost"),
        F.lit(entry_count).cast("bigint").alias("entry_count"),
        F.lit(avg_doc_len).cast("double").alias("avg_doc_len"),
        F.lit(term_buckets(entry_count)).alias("term_buckets"),
        F.lit(docs_per_block(entry_count)).cast("bigint").alias("docs_per_block"),
        F.lit(build_dir.rsplit("/", 1)[-1]).alias("build"),
        F.to_json(F.create_map(*(F.lit(x) for name in TABLES for x in (name, schemas[name].json())))).alias("schemas"),
    )
    row.write.mode("append").parquet(f"{output_dir}/metadata")


def _builds(spark: SparkSession, index_dir: str) -> DataFrame:
    try:
        return spark.read.parquet(f"{index_dir}/metadata")
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise FileNotFoundError(f"Index not found in {index_dir}") from error
        raise


def term_buckets(n_docs: int) -> int:
    return max(1, min(MAX_PARTITIONS, n_docs // DOCS_PER_TERM_BUCKET))


def id_block(doc_id: Column, per_block: int) -> Column:
    return ((doc_id - doc_id % per_block) / per_block).cast("int")


def docs_per_block(n_docs: int) -> int:
    return max(DOCS_PER_ID_BLOCK, -(-n_docs // MAX_PARTITIONS))


def read_metadata(spark: SparkSession, index_dir: str) -> DataFrame:
    """The row of the build in force."""
    return _builds(spark, index_dir).orderBy(F.col("created_at").desc(), "build").limit(1)


def remove_old_builds(spark: SparkSession, index_dir: str, *, keep: int = 1, grace_seconds: float = 86_400.0) -> list[str]:
    """Deletes the tables of builds that are neither among the ``keep`` latest nor were replaced
    less than ``grace_seconds`` ago, and returns their names.

    Searches described before then fail if they are run afterwards. A build is
    replaced when the next one's metadata row is written; names of deleted ones stay there.
    """
    if keep < 1:
        raise ValueError("the build in force can't be removed")
    latest_first = Window.orderBy(F.col("created_at").desc(), "build")  # one row per build
    builds = _builds(spark, index_dir).select(
        "build",
        F.row_number().over(latest_first).alias("place"),
        F.lag("created_at").over(latest_first).alias("replaced_at"),
    )
    age = F.current_timestamp().cast("double") - F.col("replaced_at").cast("double")
    old = [row["build"] for row in builds.where((F.col("place") > keep) & (age >= grace_seconds)).collect()]
    for build in old:
        remove(spark, f"{index_dir}/{build}")
    return old


def load_index(spark: SparkSession, index_dir: str) -> Index:
    """Tables of a stored index; ``Index not found`` if any part is missing."""
    meta = read_metadata(spark, index_dir).first()
    if meta is None:
        raise FileNotFoundError(f"Index not found in {index_dir}")
    schemas = json.loads(meta["schemas"])
    try:
        tables = [
            spark.read.schema(StructType.fromJson(json.loads(schemas[name]))).parquet(
                f"{index_dir}/{meta['build']}/{name}"
            )
            for name in TABLES
        ]
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"Index not found in {index_dir}") from error
        raise
    return Index(
        *tables,
        n_docs=F.lit(meta["entry_count"]),
        avg_doc_len=F.lit(meta["avg_doc_len"]),
        term_buckets=meta["term_buckets"],
        docs_per_block=meta["docs_per_block"],
    )
