"""Token files: Parquet with one list of ids per document, in ascending order of document id.

Ids are dictionary-encoded (a token vocabulary fits one dictionary page), the
ascending columns use delta encoding. Row groups and pages are kept small and
pages are indexed, so a reader can fetch some documents, or only the lengths,
without the ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineseek.llm.tokens import default_tokenizer, id_lists, portions, shared_encoder, with_end
from lineseek.llm.work import shuffle_partitions, tidy

ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 16 << 20, 256 << 10, 1000
CACHED_WORDS = 600_000
DELTA_COLUMNS = ("doc_id", "part", "local_start", "n_tokens")


def write_token_files(
    documents: DataFrame,
    path: str,
    *,
    tokenizer: str | None = None,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    partitions: int | None = None,
) -> None:
    """Write ``doc_id, part, local_start, n_tokens, ids`` for every row of ``documents``.

    File ``part`` holds a range of ids in order (null first); ``local_start``
    counts the ids before a document within its part. Null texts have the end
    id alone. Rows of one id stand side by
    side in order of their text. Other columns
    don't matter. An empty table writes a table without rows.
    """
    tokenizer = tokenizer or default_tokenizer()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, written, part = shared_encoder(tokenizer, CACHED_WORDS), 0, TaskContext.get().partitionId()
        for batch in portions(batches, 1):
            ids, bounds = with_end(*encoder.encode(batch.column(1)), end_id)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.full(len(batch), part, np.int32)),
                    pa.array(written + bounds[:-1]),
                    pa.array(np.diff(bounds)),
                    id_lists(ids, bounds),
                ],
                ["doc_id", "part", "local_start", "n_tokens", "ids"],
            )
            written += int(bounds[-1])

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(partitions or shuffle_partitions(documents.sparkSession), "doc_id")
    coded = rows.sortWithinPartitions("doc_id", "text").mapInArrow(
        tidy(encode), "doc_id bigint, part int, local_start bigint, n_tokens bigint, ids array<int>"
    )
    options = {
        "compression": "zstd",
        "parquet.writer.version": "v2",
        "parquet.block.size": ROW_GROUP_BYTES,
        "parquet.page.size": PAGE_BYTES,
        "parquet.page.row.count.limit": PAGE_ROWS,
        **{f"parquet.enable.dictionary#{name}": "false" for name in DELTA_COLUMNS},
    }
    coded.write.options(**options).parquet(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens`` of each document; reads no ids.

    Parts are summed first, so what is ordered in one place is a row per part.
    """
    files = spark.read.parquet(path).select("doc_id", "part", "local_start", "n_tokens")
    return _with_starts(files, files).select("doc_id", "start", "n_tokens")


def _with_starts(rows: DataFrame, files: DataFrame) -> DataFrame:
    before = Window.orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy(F.col("part").alias("part_no")).agg(F.sum("n_tokens").alias("held"))
    parts = parts.select("part_no", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("part_start"))
    joined = rows.join(parts, F.col("part") == F.col("part_no"))
    return joined.withColumn("start", F.col("part_start") + F.col("local_start"))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` read back from the files."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            bounds = lists.offsets.to_numpy()
            raw = memoryview(lists.values.to_numpy().astype(np.uint32)).cast("B")
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), batch.column(2),
                    pa.array(np.diff(bounds).astype(np.int64)), pa.array(sums, pa.int64()),
                ],
                ["doc_id", "part", "local_start", "n_tokens", "ids_crc32"],
            )

    files = spark.read.parquet(path)
    rows = files.select("doc_id", "part", "local_start", "ids").mapInArrow(
        digest, "doc_id bigint, part int, local_start bigint, n_tokens bigint, ids_crc32 bigint"
    )
    return _with_starts(rows, files).select("doc_id", "start", "n_tokens", "ids_crc32")
