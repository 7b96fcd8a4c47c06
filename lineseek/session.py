"""Small helpers around the Spark session: shared scratch tables and settings."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000  # narrow rows that may be sent to every task

DUPLICATE_KEYS = "spark.sql.variant.allowDuplicateKeys"

_local_dir: str | None = None
_owned: list[list[str]] = []  # paths made within each open ``scratch_run``


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only where all tasks run inside this machine's one JVM, and the setting is
    absent, is it a temporary folder.
    """
    global _local_dir
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="lineseek-")
    return _local_dir


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, on whatever store it lies; nothing happens if it isn't there."""
    files, hadoop = _file_system(spark, path)
    files.delete(hadoop, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder. It is removed when the enclosing
    ``scratch_run`` ends, or else with the session's JVM."""
    path = f"{shared_dir(spark)}/lineseek-{label}-{uuid.uuid4().hex}"
    files, hadoop = _file_system(spark, path)
    files.deleteOnExit(hadoop)
    if _owned:
        _owned[-1].append(path)
    return path


@contextmanager
def scratch_run(spark: SparkSession) -> Iterator[None]:
    """Owner of the tables materialised inside: all are removed at its end, also
    after an error. For runs whose result is written, not for lazy results."""
    _owned.append([])
    try:
        yield
    finally:
        for path in _owned.pop():
            remove(spark, path)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Used where later steps must see one fixed version of the rows (numbering
    that depends on scan order) or where recomputing would repeat a full scan.
    The table also gives Catalyst a true size to plan joins with.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise_bucketed(df: DataFrame, label: str, *keys: str) -> DataFrame:
    """``materialise`` into as many buckets by ``keys`` as a shuffle has partitions.

    Nothing is shuffled for it: each task adds a file to the buckets it has rows for.
    A join on ``keys`` then moves the other side only. The catalog knows the table
    only while it is written; its files are kept and removed like all others.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        df.write.format("parquet").option("path", path).bucketBy(buckets, *keys).saveAsTable(name)
        return spark.table(name).select("*")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


@contextmanager
def last_duplicate_key_wins(spark: SparkSession):
    """Let parsed JSON objects repeat a key (the last one counts).

    Spark fixes this setting while the expression is analysed, so it only has
    to be on while a DataFrame is being described.
    """
    before = spark.conf.get(DUPLICATE_KEYS)
    spark.conf.set(DUPLICATE_KEYS, "true")
    try:
        yield
    finally:
        spark.conf.set(DUPLICATE_KEYS, before)


def bind(df: DataFrame, **values: Column) -> DataFrame:
    """``withColumn`` for expensive values used by later filters and columns.

    Catalyst moves a filter below a projection by copying the projected
    expression into it, once per use. A one-row generator is a boundary that
    filters on its output do not cross, so each value is computed once per row.
    """
    for name, value in values.items():
        df = df.select("*", F.explode(F.array(value)).alias(name))
    return df


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, as a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def broadcast_if_few(df: DataFrame, rows: int | None) -> DataFrame:
    """Hints a broadcast of ``df`` if it is known to have few rows, and against one if it is
    known to have many: stored rows that compress well look small to Catalyst, which
    would gather them in the driver. Without a count the join is left to Catalyst."""
    if rows is None:
        return df
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")
