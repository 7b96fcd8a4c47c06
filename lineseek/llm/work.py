"""Tables in the folder that all executors share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
TIDY_BYTES = 1 << 20  # smaller groups leave too little behind to hand it back each time

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the setting is absent, a local session gets a folder of its own (all
    its tasks run on this machine); any other master must name one.
    """
    global _own_dir
    configured = spark.conf.get(CHECKPOINT_DIR, None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="lineseek-llm-")
    return _own_dir


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/llm-{label}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: it cuts
    the lineage, survives lost executors, and fixes row order and numbering."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Hand memory that was freed back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it decides by itself
        return


def tidy(stage: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """For a stage of Arrow batches: its worker lives on and serves other stages,
    so what it held is handed back when its partition is done."""

    @wraps(stage)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from stage(batches)
        finally:
            release()

    return run


def tidy_group(stage: Callable[[pa.Table], pa.Table]):
    """The same for a stage that gets whole groups as tables."""

    def run(group: pa.Table) -> pa.Table:
        try:
            return stage(group)
        finally:
            if group.nbytes > TIDY_BYTES:
                release()

    return run


def tidy_cogroup(stage: Callable[[pa.Table, pa.Table], pa.Table]):
    """The same for a stage that gets pairs of groups."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return stage(left, right)
        finally:
            if left.nbytes + right.nbytes > TIDY_BYTES:
                release()

    return run
