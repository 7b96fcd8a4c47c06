"""Lemmatisation by a ``token, lemma`` table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineseek.session import materialise


def _dictionary(lemmas: DataFrame) -> DataFrame:
    known = lemmas.where(F.col("token").isNotNull() & F.col("lemma").isNotNull())
    return known.groupBy("token").agg(F.min("lemma").alias("lemma"))


def lemmatise_words(words: DataFrame, column: str, lemmas: DataFrame | None = None) -> DataFrame:
    """Replace ``column``, one token per row, by its lemma; unknown tokens stay."""
    if lemmas is None:
        return words
    dictionary = _dictionary(lemmas).select(F.col("token").alias("_token"), F.col("lemma").alias("_lemma"))
    joined = words.join(dictionary, F.col(column) == F.col("_token"), "left")
    return joined.withColumn(column, F.coalesce("_lemma", column)).drop("_token", "_lemma")


def lemmatise(df: DataFrame, column: str, lemmas: DataFrame | None = None) -> DataFrame:
    """Replace each token of the array ``column`` by its lemma; unknown tokens stay.

    Without a table nothing changes. Otherwise the rows are written once with a
    number of their own; their tokens meet the dictionary by a join, and only the
    places that change come back to the rows. Rows may repeat, and the
    dictionary's size changes nothing but Spark's choice of the join.
    """
    if lemmas is None:
        return df
    rows = materialise(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    words = rows.select("_row", F.posexplode(column).alias("_place", "token"))
    changed = words.join(_dictionary(lemmas), "token").where("lemma <> token")
    by_row = changed.groupBy("_row").agg(
        F.map_from_entries(F.collect_list(F.struct("_place", "lemma"))).alias("_changes")
    )
    tokens = F.coalesce(F.col(column), F.array().cast("array<string>"))
    replaced = F.transform(tokens, lambda token, place: F.coalesce(F.col("_changes")[place], token))
    return (
        rows.join(by_row, "_row", "left")
        .withColumn(column, F.when(F.col("_changes").isNull(), tokens).otherwise(replaced))
        .select(df.columns)
    )
