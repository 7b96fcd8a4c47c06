"""Exact deduplication with counting quotient filters.

1. Each task files the 64-bit fingerprints of its texts in a counting quotient
   filter: the high bits name the slot, only the low bits (the remainder) and a
   count are stored, in order. It is cut into ranges of slots.
2. The pieces of one range from all tasks merge by their sorted remainders and
   add their counts. Nothing is lost, so a count above one is exact.
3. Only texts whose fingerprint counts above one are compared byte by byte: they
   are grouped by the text itself, combined in each task before the shuffle, so
   a text in a third of all rows is a few rows per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineseek.llm.work import shuffle_partitions

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SALTS = 16  # tasks that the rows of one fingerprint are routed to
FILTER_SCHEMA = "slots int, quotient_bits int, occupied binary, run_ends binary, remainders binary, counts binary"


def normalised(text: Column) -> Column:
    """Text with A-Z lower-cased; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


class CountingQuotientFilter:
    """Sorted fingerprints with counts; ``occupied`` has a bit per slot, ``run_ends``
    a bit per stored remainder that ends its slot's run."""

    def __init__(self, bits: int, fingerprints: np.ndarray, counts: np.ndarray):
        self.bits, self.fingerprints, self.counts = bits, fingerprints, counts

    @classmethod
    def of(cls, fingerprints: np.ndarray, least_bits: int) -> CountingQuotientFilter:
        values, counts = np.unique(fingerprints, return_counts=True)
        bits = int(np.clip(np.ceil(np.log2(max(len(values), 1) / 0.75)), least_bits, 32))
        return cls(bits, values, counts)

    def pieces(self, range_bits: int) -> Iterator[tuple]:
        """One row of FILTER_SCHEMA for each range of slots that holds anything."""
        remainder_bits = np.uint64(64 - self.bits)
        quotients = (self.fingerprints >> remainder_bits).astype(np.int64)
        remainders = self.fingerprints & ((np.uint64(1) << remainder_bits) - np.uint64(1))
        ranges = quotients >> (self.bits - range_bits)
        starts = np.flatnonzero(np.diff(ranges, prepend=-1))
        for start, end in zip(starts, [*starts[1:], len(ranges)], strict=True):
            slots = quotients[start:end] & ((1 << (self.bits - range_bits)) - 1)
            occupied = np.zeros(1 << (self.bits - range_bits), bool)
            occupied[slots] = True
            yield (
                int(ranges[start]),
                self.bits,
                np.packbits(occupied).tobytes(),
                np.packbits(np.diff(slots, append=-1) != 0).tobytes(),
                remainders[start:end].tobytes(),
                self.counts[start:end].astype(np.int64).tobytes(),
            )

    @staticmethod
    def read(piece: tuple, range_bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints, in order, and counts of one piece."""
        slots, bits, occupied, run_ends, remainders, counts = piece
        remainders = np.frombuffer(remainders, np.uint64)
        held = np.flatnonzero(np.unpackbits(np.frombuffer(occupied, np.uint8), count=1 << (bits - range_bits)))
        ends = np.unpackbits(np.frombuffer(run_ends, np.uint8), count=len(remainders)).astype(np.int64)
        run = np.cumsum(ends) - ends  # which of the held slots a remainder belongs to
        quotients = (slots << (bits - range_bits)) + held[run]
        return (quotients.astype(np.uint64) << np.uint64(64 - bits)) | remainders, np.frombuffer(counts, np.int64)


def _build(range_bits: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for batch in batches]
        if not sum(map(len, found)):
            return
        rows = CountingQuotientFilter.of(np.concatenate(found), range_bits).pieces(range_bits)
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        columns = [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, [field.split()[0] for field in FILTER_SCHEMA.split(", ")])

    return build


def _merge(range_bits: int):
    def merge(pieces: pa.Table) -> pa.Table:
        columns = [pieces.column(name).to_pylist() for name in pieces.column_names]
        parts = [CountingQuotientFilter.read(piece, range_bits) for piece in zip(*columns, strict=True)]
        fingerprints = np.concatenate([part[0] for part in parts])
        counts = np.concatenate([part[1] for part in parts])
        order = np.argsort(fingerprints, kind="stable")
        fingerprints, counts = fingerprints[order], counts[order]
        starts = np.flatnonzero(np.concatenate([[True], fingerprints[1:] != fingerprints[:-1]]))
        total = np.add.reduceat(counts, starts)
        many = total > 1
        return pa.table({"fp": fingerprints[starts][many].view(np.int64), "fp_rows": total[many]})

    return merge


def repeated_fingerprints(fingerprints: DataFrame) -> DataFrame:
    """``fp, fp_rows`` for every value of column ``fp`` that occurs more than once.

    There are some eight ranges of slots to each shuffle partition, so what a
    task merges at once shrinks as the cluster is given more partitions.
    """
    range_bits = min(20, int(np.ceil(np.log2(shuffle_partitions(fingerprints.sparkSession)))) + 3)
    pieces = fingerprints.select("fp").mapInArrow(_build(range_bits), FILTER_SCHEMA)
    return pieces.groupBy("slots").applyInArrow(_merge(range_bits), "fp bigint, fp_rows bigint")


def _with_keys(documents: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    text = normalised(F.col(text_col))
    return documents.select(
        F.col(id_col).alias("id"), text.alias("norm"), F.xxhash64(text).alias("fp"), *more
    )


def duplicate_groups(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``fp, sha, keep_id, group_size`` for every text that at least two rows hold."""
    keyed = _with_keys(documents, id_col, text_col)
    repeated = repeated_fingerprints(keyed).select(
        F.col("fp").alias("many_fp"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("many_salt")
    )
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    routed = salted.join(
        repeated.hint("shuffle_hash"),
        (F.col("fp") == F.col("many_fp")) & (F.col("salt") == F.col("many_salt")),
        "left_semi",
    )
    groups = routed.groupBy("fp", "norm").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    return groups.where("group_size > 1").select("fp", F.sha2("norm", 256).alias("sha"), "keep_id", "group_size")


def exact_duplicates(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fingerprint: str | None = None
) -> DataFrame:
    """One row per row of ``documents``: ``id_col, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are after lower-casing A-Z; null counts as empty.
    The largest id of a group stays. Rows that repeat both id and text are one
    document delivered again: they count in ``group_size`` and share ``kept``.
    A null id never beats another id; a group of null ids only keeps them all.
    Other columns don't matter. An empty table gives no rows.
    """
    groups = duplicate_groups(documents, id_col=id_col, text_col=text_col)
    rows = _with_keys(documents, id_col, text_col).select("id", "fp", F.sha2("norm", 256).alias("sha"))
    joined = rows.join(groups, ["fp", "sha"], "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("id")).otherwise(F.col("keep_id"))
    return joined.select(
        F.col("id").alias(id_col),
        *([F.col("fp").alias(fingerprint)] if fingerprint else []),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_duplicates(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` that stay, one for each text, all columns as they were.

    The losers' ids travel to the rows, so a group of copies is spread by its
    rows' ids, whatever its size.
    """
    text = normalised(F.col(f"row.{text_col}"))
    rows = documents.select(F.struct("*").alias("row")).select(
        "row", F.col(f"row.{id_col}").alias("id"), F.xxhash64(text).alias("fp")
    )
    judged = exact_duplicates(documents, id_col=id_col, text_col=text_col, fingerprint="lost_fp")
    losers = judged.where(~F.col("kept")).select(F.col(id_col).alias("lost_id"), "lost_fp").distinct()
    lost = F.col("id").eqNullSafe(F.col("lost_id")) & (F.col("fp") == F.col("lost_fp"))
    return rows.join(losers, lost, "left_anti").dropDuplicates(["id", "fp"]).select("row.*")
