"""Field statistics of schemaless entries."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineseek.functions.values import array_head, kind_of, string_of, value_length, value_type
from lineseek.session import broadcast_if_few, materialise
from lineseek.sources.jsonl import running_start

# Tasks get the functions below themselves, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHORT_TEXT = 100  # only strings shorter than this count as distinct values
DISTINCT_CAP = 1000  # more distinct values than this are reported as null
SMALL_SAMPLE = 10_000  # entries that may be sorted in one place


def head_sample(entries: DataFrame, size: int | None) -> DataFrame:
    """The first ``size`` entries by ``pos``; all of them for 0 or None."""
    if size is not None and size < 0:
        raise ValueError("sample size must not be negative")
    if not size:
        return entries
    if size <= SMALL_SAMPLE:
        return materialise(entries.orderBy("pos").limit(size), "sample")
    # No longer prefix passes through one task, whatever its size: rows are numbered inside
    # range partitions of pos, written once so that the partitions stay fixed.
    ranged = materialise(
        entries.repartitionByRange("pos").withColumn("_part", F.spark_partition_id()), "sample"
    )
    starts = running_start(ranged.groupBy("_part").agg(F.count("*").alias("_n")), ["_part"], "_n", "_start")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("pos"))
    return (
        ranged.withColumn("_rank", inside)
        .join(starts.select("_part", "_start"), "_part")
        .where(F.col("_start") + F.col("_rank") <= size)
        .select(entries.columns)
    )


def explode_fields(entries: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """``pos, field, value, opens_entry``: one row per field of each entry.

    Exactly one row of every entry has ``opens_entry`` true, even for an entry
    without fields, so entries can be counted in the same pass. Rows of fields
    that were not asked for keep a null ``field``. Elements of a top-level array
    are named by their index.
    """
    spark = entries.sparkSession
    pairs = spark.tvf.variant_explode_outer(F.col("entry").outer()).toDF("_slot", "_key", "value")
    name = F.coalesce(F.col("_key"), F.col("_slot").cast("string"))
    wanted = name if fields is None else F.when(name.isin(list(fields)), name)
    return entries.lateralJoin(pairs).select(
        "pos",
        wanted.alias("field"),
        "value",
        (F.col("_slot").isNull() | (F.col("_slot") == 0)).alias("opens_entry"),
    )


def _described(exploded: DataFrame) -> DataFrame:
    """Adds ``type``, ``length`` and ``short`` (the value if it is a short string).

    Each step is a projection of its own: what several later columns use is
    computed once per value.
    """
    value, kind, text = F.col("value"), F.col("kind"), F.col("text")
    return (
        exploded.withColumn("kind", F.when(F.col("field").isNotNull(), kind_of(value)))
        .withColumns({"text": string_of(value, kind), "head": array_head(value, kind)})
        .withColumns({"type": value_type(kind, F.col("head")), "length": value_length(value, kind, text)})
        .withColumn("short", F.when(F.col("length") < SHORT_TEXT, text))
        .drop("value", "kind", "text", "head")
    )


class _Distinct:
    """Hashes of the short strings of each field, up to one more than are reported."""

    def __init__(self):
        self.by_field: dict[str | None, np.ndarray] = {}
        self.size = 0

    def add(self, field: str | None, hashes: np.ndarray) -> None:
        held = self.by_field.get(field)
        if held is None:
            held = hashes[:0]
        if len(held) <= DISTINCT_CAP:
            self.by_field[field] = np.union1d(held, hashes)[: DISTINCT_CAP + 1]
            self.size += len(self.by_field[field]) - len(held)

    def rows(self) -> pa.RecordBatch:
        fields, hashes = list(self.by_field), list(self.by_field.values())
        owner = np.repeat(np.arange(len(fields)), [len(h) for h in hashes])
        n = len(owner)
        zeros = pa.array(np.zeros(n, np.int64))
        self.by_field, self.size = {}, 0
        return pa.RecordBatch.from_arrays(
            [pa.array(fields, pa.string()).take(pa.array(owner)), pa.nulls(n, pa.string()), zeros, zeros, zeros,
             pa.array(np.concatenate([np.zeros(0, np.int64), *hashes]))],
            PARTIAL_NAMES,
        )


PARTIAL_NAMES = ["field", "type", "n", "length", "opens", "hash"]
HELD_HASHES = 2_000_000


def _partial_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each batch by field and type, and a task's distinct hashes by field."""
    distinct = _Distinct()
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        sums = table.group_by(["field", "type"]).aggregate([([], "count_all"), ("length", "sum"), ("opens", "sum")])
        yield pa.RecordBatch.from_arrays(
            [sums["field"].combine_chunks(), sums["type"].combine_chunks(), sums["count_all"].combine_chunks(),
             sums["length_sum"].combine_chunks(), sums["opens_sum"].combine_chunks(), pa.nulls(sums.num_rows, pa.int64())],
            PARTIAL_NAMES,
        )
        short = table.filter(pc.is_valid(table["hash"]))
        fields = short["field"].combine_chunks().dictionary_encode()
        code, hashes = fields.indices.to_numpy(), short["hash"].to_numpy()
        order = np.argsort(code, kind="stable")
        bounds = np.searchsorted(code[order], np.arange(len(fields.dictionary) + 1))
        for i, field in enumerate(fields.dictionary.to_pylist()):
            distinct.add(field, hashes[order[bounds[i] : bounds[i + 1]]])
        if distinct.size > HELD_HASHES:
            yield distinct.rows()
    yield distinct.rows()


def _field_totals(exploded: DataFrame) -> DataFrame:
    """One row per field (and one for the null field) with mergeable totals.

    Short strings count by their 64-bit hash. A task keeps no more than 1001
    distinct ones of a field: if that drops any, the field has too many to be
    reported, and otherwise what the tasks keep is all there is. So what moves is
    bounded by the fields, however many values an id-like one has.
    """
    hashed = F.when(F.col("short").isNotNull(), F.xxhash64("short"))
    rows = _described(exploded).select(
        "field", "type", F.col("length").cast("bigint").alias("length"),
        F.col("opens_entry").cast("bigint").alias("opens"), hashed.alias("hash"),
    )
    parts = rows.mapInArrow(
        _partial_totals, "field string, type string, n bigint, length bigint, opens bigint, hash bigint"
    )
    once = parts.groupBy("field", "type", "hash").agg(
        F.sum("n").alias("n"), F.sum("length").alias("length"), F.sum("opens").alias("opens")
    )
    return once.groupBy("field").agg(
        F.min("type").alias("type"),
        F.max("type").alias("other_type"),
        F.sum("n").alias("n"),
        F.sum("length").alias("length"),
        F.sum("opens").alias("opens"),
        F.count("hash").alias("distinct"),
    )


def _counted_values(exploded: DataFrame, fields: DataFrame) -> DataFrame:
    """``field, last_n``: how often the last one of the short strings of some fields occurs.

    Tracking is given up by the next short string, even a repeat, once the cap is
    reached. So a field at the cap keeps its count only if the value completing
    it came last, that is if the last short string occurs once.
    """
    return (
        _described(exploded.join(fields, "field", "left_semi"))
        .where(F.col("short").isNotNull())
        .groupBy("field", "short")
        .agg(F.count("*").alias("n"), F.max("pos").alias("last_pos"))
        .groupBy("field")
        .agg(F.max_by("n", "last_pos").alias("last_n"))
    )


def profile_entries(
    entries: DataFrame, fields: list[str] | None = None, sample_size: int | None = None
) -> tuple[DataFrame, int]:
    """Field statistics of ``entries(pos, entry)`` and the number of entries.

    Returns ``field, type, coverage, avg_length, unique_values``. The entries are
    read once; a second pass reads those fields that hold exactly 1000 distinct values,
    where the order of entries decides.
    """
    exploded = explode_fields(head_sample(entries, sample_size), fields)
    totals = materialise(_field_totals(exploded), "fields")
    entry_count = totals.agg(F.sum("opens")).first()[0] or 0

    named = totals.where(F.col("field").isNotNull())
    full = named.where(F.col("distinct") == DISTINCT_CAP).select("field")
    n_full = full.count()
    if n_full:
        named = named.join(_counted_values(exploded, broadcast_if_few(full, n_full)), "field", "left")
    else:
        named = named.withColumn("last_n", F.lit(None).cast("bigint"))

    distinct = F.col("distinct")
    profile = named.select(
        "field",
        F.when(F.col("type") == F.col("other_type"), F.col("type")).otherwise("mixed").alias("type"),
        F.round(F.col("n") / F.lit(entry_count) * 100).cast("bigint").alias("coverage"),
        F.round(F.col("length") / F.col("n")).cast("bigint").alias("avg_length"),
        F.when((distinct < DISTINCT_CAP) | ((distinct == DISTINCT_CAP) & (F.col("last_n") == 1)), distinct).alias(
            "unique_values"
        ),
    )
    return profile, entry_count
