"""JSON-lines input: scan, strict parse, document extraction, numbering, size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineseek.functions.numbers import format_size
from lineseek.functions.values import field_path, is_falsy, kind_of
from lineseek.session import bind, last_duplicate_key_wins, let, materialise, materialise_bucketed


def scan_lines(spark: SparkSession, path: str, up_to_file: str | None = None) -> DataFrame:
    """``pos, line`` for every line that is not blank.

    ``pos`` orders the lines: file, block of the file, row within the scan. It is
    taken right at the scan, before any filter, and needs no second pass.
    ``up_to_file`` leaves out files whose path sorts after it, unopened.
    """
    pos = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    text = spark.read.text(path)
    if up_to_file is not None:
        text = text.where(F.col("_metadata.file_path") <= up_to_file)
    lines = text.select(pos.alias("pos"), F.col("value").alias("line"))
    return lines.where(F.col("line").rlike(r"(?U)\S"))


def nth_file(spark: SparkSession, path: str, n: int) -> str | None:
    """Path of the n-th file in path order, or None if there are no more than n."""
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"))
    first = [row["file"] for row in files.orderBy("file").limit(n + 1).collect()]
    return first[n - 1] if len(first) > n else None


def _strict_entry(line: Column) -> Column:
    """The line as VARIANT, or null unless it is exactly one JSON value.

    ``try_parse_json`` ignores text after the first value. Inside brackets such a
    tail shows as a second element or as an error, unless it starts with ``]``;
    inside an object wrapper it is an error unless it starts with ``}`` or with
    ``,"key":``. No tail passes both, so both parses together are strict. A line
    that starts with ``{`` and has no ``}`` followed by ``]`` cannot close the
    brackets early, so one parse settles it; that is the usual line.
    """
    keyed = F.try_parse_json(F.concat(F.lit('{"v":'), line, F.lit("}")))
    plain_object = F.ltrim(line).startswith("{") & ~line.rlike(r"\}\s*\]")

    def only_value(listed: Column) -> Column:
        alone = F.variant_get(listed, "$[1]", "variant").isNull()
        return F.when(alone & (plain_object | keyed.isNotNull()), F.variant_get(listed, "$[0]", "variant"))

    return let(F.try_parse_json(F.concat(F.lit("["), line, F.lit("]"))), only_value)


def parse_lines(lines: DataFrame) -> DataFrame:
    """Adds ``entry VARIANT``; null marks a line that is not valid JSON."""
    with last_duplicate_key_wins(lines.sparkSession):
        return bind(lines, entry=_strict_entry(F.col("line")))


def entries_of(lines: DataFrame) -> DataFrame:
    """``pos, entry`` of the valid lines."""
    return parse_lines(lines).where(F.col("entry").isNotNull()).select("pos", "entry")


def _examined(lines: DataFrame, content_field: str, title_field: str) -> DataFrame:
    """Parsed lines with content, title and the reason a line is not a document."""
    content, title = F.col("content_value"), F.col("title_value")
    content_kind, title_kind = F.col("content_kind"), F.col("title_kind")
    reason = (
        F.when(F.col("entry").isNull(), "bad_json")
        .when(F.is_variant_null("entry"), "bad_entry")
        .when(is_falsy(content, content_kind), "no_content")
        .when(content_kind != "STRING", "not_string")
        .when(~is_falsy(title, title_kind) & (title_kind != "STRING"), "not_string")
    )
    values = bind(
        parse_lines(lines),
        content_value=F.variant_get("entry", field_path(content_field), "variant"),
        title_value=F.variant_get("entry", field_path(title_field), "variant"),
    )
    return bind(values, content_kind=kind_of(content), title_kind=kind_of(title), reason=reason)


def extract_documents(lines: DataFrame, content_field: str = "content", title_field: str = "title") -> DataFrame:
    """``pos, title, content, original_entry`` of the lines that are documents."""
    title = F.when(F.col("title_kind") == "STRING", F.try_variant_get("title_value", "$", "string"))
    return (
        _examined(lines, content_field, title_field)
        .where(F.col("reason").isNull())
        .select(
            "pos",
            F.coalesce(title, F.lit("")).alias("title"),
            F.try_variant_get("content_value", "$", "string").alias("content"),
            F.col("entry").alias("original_entry"),
        )
    )


def rejected_lines(lines: DataFrame, content_field: str = "content", title_field: str = "title") -> DataFrame:
    """``pos, reason, line`` of the lines that are not documents."""
    return (
        _examined(lines, content_field, title_field)
        .where(F.col("reason").isNotNull())
        .select("pos", "reason", "line")
    )


def running_start(counts: DataFrame, order: list[str], count: str, start: str) -> DataFrame:
    """Adds ``start``: the sum of ``count`` over all rows before this one.

    A distributed prefix sum: range partitions are summed in parallel, and only
    one total per partition (at most ``spark.sql.shuffle.partitions`` rows) is
    accumulated in a single task. The range partitions are written out first,
    because both steps must see the same ones.
    """
    ranged = materialise(
        counts.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges"
    )
    before = (Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(F.sum(count).alias("_total"))
    offsets = totals.select(
        "_range",
        F.coalesce(F.sum("_total").over(Window.orderBy("_range").rowsBetween(*before)), F.lit(0)).alias("_offset"),
    )
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(*before)
    return (
        ranged.withColumn("_within", F.coalesce(F.sum(count).over(within), F.lit(0)))
        .join(F.broadcast(offsets), "_range")
        .withColumn(start, F.col("_offset") + F.col("_within"))
        .drop("_range", "_offset", "_within")
    )


def number_documents(extracted: DataFrame) -> DataFrame:
    """Replaces ``pos`` by a dense ``id`` from 0 in line order.

    The documents are written once with a row number taken after the filter, so
    rows of a file block are numbered without gaps. The blocks' counts give each
    block its first id. The table is bucketed by block, so these first ids come to
    the rows, and no content is shuffled, however many blocks there are. Writing first
    matters: how files are split may differ between two scans when executors
    come and go, and the numbers must not.
    """
    staged = materialise_bucketed(
        extracted.select(
            F.col("pos.file").alias("_file"),
            F.col("pos.block").alias("_block"),
            F.monotonically_increasing_id().alias("_row"),
            *[c for c in extracted.columns if c != "pos"],
        ),
        "documents", "_file", "_block",
    )
    blocks = staged.groupBy("_file", "_block").agg(
        F.min("_row").alias("_first"), F.count("*").alias("_rows")
    )
    starts = running_start(blocks, ["_file", "_block"], "_rows", "_start").drop("_rows")
    # a block's entry is small beside the block, so a bucket's entries fit where its contents do
    return (
        staged.join(materialise(starts, "blocks").hint("shuffle_hash"), ["_file", "_block"])
        .withColumn("id", F.col("_start") + F.col("_row") - F.col("_first"))
        .select("id", *[c for c in extracted.columns if c != "pos"])
    )


def read_documents(
    spark: SparkSession, path: str, content_field: str = "content", title_field: str = "title"
) -> DataFrame:
    """``id, title, content, original_entry`` of a JSON-lines file or folder."""
    return number_documents(extract_documents(scan_lines(spark, path), content_field, title_field))


def dataset_size(spark: SparkSession, path: str) -> DataFrame:
    """``bytes, file_size`` from the file listing alone; no content is read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    total = files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
    return total.withColumn("file_size", format_size(F.col("bytes")))
