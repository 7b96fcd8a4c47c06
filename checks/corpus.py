"""The test tables seen as a document collection, queries and dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineseek.functions.text import normalise, tokenise
from lineseek.plans.build import index_tables
from lineseek.session import scratch_path
from lineseek.sources.index import Index

DIM = 64


HEAVY = ("documents", "events")  # tables whose rows cost more to process than to move
SPLIT_BYTES = 128 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in HEAVY else rows


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows of a small table out to all cores.

    A Parquet row group is read by one task, so a table of one row group keeps
    every later step on one core. Only tables of less than one input split per
    core are dealt out; anything larger stays as it is read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPLIT_BYTES else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, title, content, original_entry``; the title is the first sentence
    or line of the text, whole and normalised."""
    rows = table(spark, sf_dir, "documents")
    return rows.select(
        F.col("doc_id").alias("id"),
        normalise(F.regexp_extract("text", r"^[^.\n]*", 0)).alias("title"),
        F.col("text").alias("content"),
        F.to_json(F.struct(*rows.columns)).alias("original_entry"),
    )


def content_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def title_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title vector of document d is stored vector d + 1."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select((F.col("vec_id") - 1).alias("id"), F.col("embedding").alias("vec"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id, query, query_vec`` from the benchmark texts."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")
    )
    return asked.join(vectors, "query_id", "left")


def index(spark: SparkSession, sf_dir: str, **options) -> Index:
    return index_tables(
        documents(spark, sf_dir), content_vectors(spark, sf_dir), title_vectors(spark, sf_dir), dim=DIM, **options
    )


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``token``: distinct words of the documents."""
    return table(spark, sf_dir, "documents").select(F.explode(tokenise(F.col("text"))).alias("token")).distinct()


def lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary derived from the documents: longer words lose a final s."""
    plural = F.col("token").endswith("s") & (F.char_length("token") >= 4)
    return vocabulary(spark, sf_dir).where(plural).select("token", F.regexp_replace("token", "s$", "").alias("lemma"))


def synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synsets derived from the documents' words: a one-word synset, a synset with
    a two-word synonym, the word itself, and a fourth that must not be used."""
    token = F.col("token")
    synsets = F.array(
        F.concat(token, F.lit("s")), F.concat(F.lit("near "), token), token, F.concat(token, F.lit("ing"))
    )
    return vocabulary(spark, sf_dir).select("token", F.posexplode(synsets).alias("place", "synonym")).select(
        "token", (F.col("place") + 1).alias("synset_rank"), "synonym"
    )


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pos, line``: every document as a JSON line, and after some of them a defective copy."""
    good = F.to_json(F.struct(F.col("source").alias("title"), F.col("text").alias("content")))
    copy = (
        F.when(F.col("doc_id") % 10 == 0, F.concat(good, F.lit(" x")))
        .when(F.col("doc_id") % 10 == 1, F.to_json(F.struct(F.col("source").alias("title"))))
        .when(F.col("doc_id") % 10 == 2, F.to_json(F.struct(F.col("n_chars").alias("content"))))
        .when(F.col("doc_id") % 10 == 3, F.lit("null"))
        .when(F.col("doc_id") % 10 == 4, F.to_json(F.struct(F.lit(7).alias("title"), F.col("text").alias("content"))))
    )
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.array(good, copy)).alias("place", "line"))
    return lines.where("line IS NOT NULL").select((2 * F.col("doc_id") + F.col("place")).alias("pos"), "line")


def written_lines(spark: SparkSession, sf_dir: str) -> str:
    """Folder of text files holding ``json_lines`` in order of ``pos``."""
    path = scratch(spark, "lines")
    json_lines(spark, sf_dir).orderBy("pos").select("line").write.text(path)
    return path


def scratch(spark: SparkSession, label: str) -> str:
    return scratch_path(spark, label)


def typed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pos, line``: events as entries with fields of every JSON type."""
    any_type = F.expr(
        """CASE event_id % 7 WHEN 0 THEN 'null' WHEN 1 THEN '"text"' WHEN 2 THEN cast(event_id AS string)
           WHEN 3 THEN 'true' WHEN 4 THEN '[]' WHEN 5 THEN '[1, "x"]' ELSE '{"p": 1, "q": null}' END"""
    )
    line = F.concat(
        F.lit('{"any": '), any_type,
        F.lit(', "event": "'), F.col("event_type"),
        F.lit('", "value": '), F.col("value").cast("string"),
        F.lit(', "serial": "n'), F.col("event_id").cast("string"),
        F.lit('", "cycle": "c'), (F.col("event_id") % 1000).cast("string"),
        F.lit('", "tags": [["'), F.col("event_type"), F.lit('"], 2], "flags": [null, 1]'),
        F.when(F.col("event_id") < 1000, F.concat(F.lit(', "early": "e'), F.col("event_id").cast("string"), F.lit('"')))
        .otherwise(F.lit("")),
        F.lit("}"),
    )
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), line.alias("line"))
