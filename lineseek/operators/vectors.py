"""Vectors: attaching stored ones, training, exact and approximate neighbours."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineseek.functions.text import split_words
from lineseek.functions.vectors import dot_product, zero_vector
from lineseek.operators.pair_scan import candidate_pairs
from lineseek.operators.portions import codes_of, with_words, word_portions
from lineseek.operators.word_training import skip_gram
from lineseek.session import bind, broadcast_if_few, let

PRESORTED_LIMIT = 1000  # spark.sql.optimizer.windowGroupLimitThreshold
LIMIT_GROUPS = 64
DEFAULT_DIM = 384  # length of the zero vector given to texts without a vector


def attach_vectors(
    df: DataFrame, vectors: DataFrame | None, name: str, key: str = "id", dim: int = DEFAULT_DIM
) -> DataFrame:
    """Left-joins ``vectors(<key>, vec)`` as column ``name``; missing ones are zero."""
    zeros = zero_vector(dim)
    if vectors is None:
        return df.withColumn(name, zeros)
    found = vectors.select(key, F.col("vec").cast("array<float>").alias(name))
    return df.join(found, key, "left").withColumn(name, F.coalesce(name, zeros))


def _rounded(score: Column, decimals: int | None) -> Column:
    return score if decimals is None else F.round(score, decimals)


def best_per_query(scored: DataFrame, score: str, limit: int) -> DataFrame:
    """The ``limit`` rows with the highest score of each query, ties by id, ranked.

    Spark cuts each partition to ``limit`` rows per query before the shuffle. It
    does so only up to a limit of 1000, so for a larger one the rows of a query
    are first dealt into groups by id and each group is cut on its own.
    """
    best_first = [F.col(score).desc(), F.col("id").asc()]
    if limit > PRESORTED_LIMIT:
        group = F.pmod(F.hash("id"), F.lit(LIMIT_GROUPS))
        in_group = F.row_number().over(Window.partitionBy("query_id", group).orderBy(*best_first))
        scored = scored.withColumn("rank", in_group).where(F.col("rank") <= limit)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*best_first))
    return scored.withColumn("rank", rank).where(F.col("rank") <= limit)


def nearest_exact(
    documents: DataFrame, queries: DataFrame, limit: int, decimals: int | None = None
) -> DataFrame:
    """``query_id, rank, id, similarity``: the nearest of all documents by cosine.

    ``documents`` has ``id, vec``; ``queries`` has ``query_id, query_vec``.
    """
    signals = documents.select(
        "id",
        F.lit(None).cast("string").alias("title"),
        F.col("vec").alias("content_vec"),
        F.lit(None).cast("array<float>").alias("title_vec"),
    )
    pairs = candidate_pairs(
        signals,
        queries.select("query_id", F.lit("").alias("query"), "query_vec"),
        semantic_weight=1.0,
        title_weight=0.0,
        threshold=None,
        limit=limit,
        margin=1e-9 if decimals is None else 10.0**-decimals,
    )
    scored = pairs.select("query_id", "id", _rounded(F.col("semantic_similarity"), decimals).alias("similarity"))
    return best_per_query(scored, "similarity", limit).select("query_id", "rank", "id", "similarity")


def nearest_approx(
    documents: DataFrame,
    queries: DataFrame,
    limit: int,
    *,
    bands: int = 30,
    hashes_per_band: int = 4,
    bucket_length: float = 0.3,
    seed: int = 42,
) -> DataFrame:
    """Like ``nearest_exact``, looking only at documents that share all random
    projection buckets of at least one band with the query.

    Documents are probed in place by the hashed queries; each pair is scored in
    the first band in which it meets, so a bucket with very many documents is
    neither collected nor shuffled and no pair needs to be de-duplicated.
    Vectors of norm zero have no direction and are left out.
    """

    def unit(vec: Column) -> Column:
        def scaled(values: Column) -> Column:
            norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda total, x: total + x * x))
            return F.transform(values, lambda x: x / norm)

        return let(vec.cast("array<double>"), scaled)

    def usable(df: DataFrame, vec: str) -> DataFrame:
        directed = bind(df.where(F.exists(vec, lambda x: x != 0)), direction=unit(F.col(vec)))
        return directed.withColumn("unit", array_to_vector("direction")).drop(vec)

    docs, asked = usable(documents, "vec"), usable(queries, "query_vec")
    if docs.isEmpty():
        return nearest_exact(documents.limit(0), queries, limit)
    model = BucketedRandomProjectionLSH(
        inputCol="unit", outputCol="hashed", bucketLength=bucket_length,
        numHashTables=bands * hashes_per_band, seed=seed,
    ).fit(docs)

    def with_bands(df: DataFrame, name: str) -> DataFrame:
        """One 64-bit key per band; equal keys of unequal buckets only add candidates."""
        values = F.transform("hashed", lambda h: vector_to_array(h)[0])
        hashed = bind(model.transform(df), buckets=values)
        starts = F.sequence(F.lit(1), F.lit(bands * hashes_per_band), F.lit(hashes_per_band))
        keys = F.transform(starts, lambda s: F.xxhash64(F.slice("buckets", s, hashes_per_band)))
        return bind(hashed, **{name: keys}).drop("hashed", "unit", "buckets")

    docs = with_bands(docs.select("id", F.col("direction").alias("doc_vec"), "unit"), "doc_keys")
    asked = with_bands(asked.select("query_id", F.col("direction").alias("query_vec"), "unit"), "query_keys")
    docs = docs.select("*", F.posexplode("doc_keys").alias("band", "key"))
    asked = broadcast_if_few(
        asked.select("*", F.posexplode("query_keys").alias("band", "key")), queries.count() * bands
    )
    equal = F.zip_with("doc_keys", "query_keys", lambda x, y: x == y)
    scored = docs.join(asked, ["band", "key"]).where(F.array_position(equal, True) == F.col("band") + 1).select(
        "query_id", "id", dot_product(F.col("query_vec"), F.col("doc_vec")).alias("similarity")
    )
    return best_per_query(scored, "similarity", limit).select("query_id", "rank", "id", "similarity")


def hashed_vectors(texts: DataFrame, key: str = "id", dim: int = DEFAULT_DIM) -> DataFrame:
    """``<key>, vec`` from ``<key>, text``: an embedding that needs no training.

    The md5 of a word names one of ``dim`` places and a sign; a text's vector is
    the sum over its words, scaled to length 1 (zeros for a text without words).
    Words are summed per place before they move; keys are to be unique.
    """
    words = texts.select(key, F.explode(split_words(F.col("text"))).alias("word")).select(
        key, F.md5("word").alias("digest")
    )
    places = words.select(
        key,
        (F.conv(F.substring("digest", 1, 6), 16, 10).cast("bigint") % dim).cast("int").alias("place"),
        F.when(F.substring("digest", 7, 1) < "8", 1.0).otherwise(-1.0).alias("sign"),
    )
    sums = places.groupBy(key, "place").agg(F.sum("sign").alias("total"))
    by_key = sums.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("place", "total"))).alias("totals"),
        F.sqrt(F.sum(F.col("total") * F.col("total"))).alias("norm"),
    )
    scale = F.coalesce(F.nullif(F.col("norm"), F.lit(0.0)), F.lit(1.0))
    dense = F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda place: F.coalesce(F.col("totals")[place], F.lit(0.0)) / scale,
    )
    found = by_key.select(F.col(key).alias("_key"), dense.alias("vec"))
    joined = texts.select(key).join(found, F.col(key) == F.col("_key"), "left")
    return joined.select(key, F.coalesce("vec", zero_vector(dim).cast("array<double>")).alias("vec"))


@dataclass(frozen=True, eq=False)
class WordModel:
    """A trained model: a stored table ``word, vector`` and the length of its vectors."""

    vectors: DataFrame
    dim: int


def train_word_vectors(
    documents: DataFrame, column: str, dim: int = 100, min_count: int = 5, seed: int = 42
) -> WordModel:
    """Word2Vec over token arrays, trained in as many lanes as there are cores; see ``word_training``."""
    return WordModel(skip_gram(documents, column, dim=dim, min_count=min_count, seed=seed), dim)


def word_vectors(model: WordModel) -> DataFrame:
    """``word, vector`` of a trained model."""
    return model.vectors


def _means_of_rows(dim: int):
    def mean(portion: pa.Table, found: pa.Table) -> pa.Table:
        codes, row = codes_of(portion)
        keys = portion["keys"].combine_chunks().flatten()
        values = np.zeros((int(codes.max(initial=-1)) + 2, dim))
        if found.num_rows:
            values[found["place"].to_numpy()] = found["vector"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
        sums = np.stack([np.bincount(row, values[codes, place], len(keys)) for place in range(dim)], axis=1)
        means = sums / np.maximum(np.bincount(row, minlength=len(keys)), 1)[:, None]
        bounds = pa.array(np.arange(len(keys) + 1) * dim, pa.int32())
        return pa.table([keys, pa.ListArray.from_arrays(bounds, pa.array(means.astype(np.float32).ravel()))], ["key", "vec"])

    return mean


def embed_texts(model: WordModel, texts: DataFrame, key: str = "id") -> DataFrame:
    """``<key>, vec`` from ``<key>, text``: the mean of the word vectors of a processed text, whose
    unknown words count as zeros. Each row has its own; one without words has zeros.

    A word's vector goes once to each portion of texts."""
    rows = texts.select(F.col(key).alias("key"), split_words(F.col("text")).alias("words"))
    portions = word_portions(rows, "key", "words")
    key_type = rows.schema["key"].dataType.simpleString()
    means = with_words(portions, model.vectors, _means_of_rows(model.dim), f"key {key_type}, vec array<float>")
    return means.select(F.col("key").alias(key), "vec")
