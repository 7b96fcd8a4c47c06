"""Profile of a JSON-lines collection."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineseek.operators.profile import profile_entries
from lineseek.sources.jsonl import dataset_size, entries_of, nth_file, scan_lines


class Analysis(NamedTuple):
    summary: DataFrame  # total_entries, file_size, sample_time
    fields: DataFrame  # field, type, coverage, avg_length, unique_values


def leading_entries(spark: SparkSession, path: str, size: int) -> DataFrame:
    """Entries of as many leading files as hold ``size`` entries.

    Starts with one file and widens eightfold, so a small sample of a large
    collection opens only its first files.
    """
    n_files = 1
    while (last := nth_file(spark, path, n_files)) is not None:
        entries = entries_of(scan_lines(spark, path, up_to_file=last))
        if entries.limit(size).count() == size:
            return entries
        n_files *= 8
    return entries_of(scan_lines(spark, path))


def analyze(
    spark: SparkSession, path: str, fields: list[str] | None = None, sample_size: int | None = None
) -> Analysis:
    """Field statistics of a JSON-lines file or folder.

    ``fields`` restricts the report to some field names; ``sample_size`` looks at
    the first entries only. Totals count every entry looked at.
    """
    if sample_size and sample_size > 0:
        entries = leading_entries(spark, path, sample_size)
    else:
        entries = entries_of(scan_lines(spark, path))
    profile, entry_count = profile_entries(entries, fields, sample_size)
    summary = dataset_size(spark, path).select(
        F.lit(entry_count).cast("bigint").alias("total_entries"),
        "file_size",
        F.current_timestamp().alias("sample_time"),
    )
    return Analysis(summary, profile)
