"""Query preparation: terms, synonym expansion, nearest-word expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineseek.functions.text import content_words, tokenise
from lineseek.operators.lemmas import lemmatise_words
from lineseek.operators.vectors import nearest_exact

SYNSETS_PER_TOKEN = 3
WORDS_PER_TOKEN = 3
MIN_TOKEN_LENGTH = 3


def expansion_tokens(queries: DataFrame) -> DataFrame:
    """``query_id, token``: raw lower-case words long enough to expand."""
    tokens = queries.select("query_id", F.explode(F.array_distinct(tokenise(F.col("query")))).alias("token"))
    return tokens.where(F.char_length("token") >= MIN_TOKEN_LENGTH)


def expand_synonyms(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """``query_id, expansion``: distinct synonyms from each token's first synsets.

    ``synonyms`` has ``token, synset_rank, synonym``; the limit counts synsets,
    each of which may hold several words.
    """
    near = synonyms.where(F.col("synset_rank") <= SYNSETS_PER_TOKEN).where(F.col("synonym") != F.col("token"))
    return (
        expansion_tokens(queries)
        .join(near, "token")
        .select("query_id", F.col("synonym").alias("expansion"))
        .distinct()
    )


def expand_similar_words(queries: DataFrame, word_vectors: DataFrame, count: int = WORDS_PER_TOKEN) -> DataFrame:
    """``query_id, expansion``: the nearest words of each token by word vector."""
    tokens = expansion_tokens(queries)
    near = nearest_words(tokens.select("token").distinct(), word_vectors, count)
    return tokens.join(near, "token").select("query_id", F.col("word").alias("expansion")).distinct()


def nearest_words(
    tokens: DataFrame, word_vectors: DataFrame, count: int = WORDS_PER_TOKEN, decimals: int | None = None
) -> DataFrame:
    """``token, rank, word, similarity`` over ``word_vectors(word, vector)``; similarities
    rounded to ``decimals`` before they are ranked, ties by word."""
    vocabulary = word_vectors.select(F.col("word").alias("id"), F.col("vector").alias("vec"))
    asked = tokens.join(word_vectors, tokens["token"] == word_vectors["word"]).select(
        F.col("token").alias("query_id"), F.col("vector").alias("query_vec")
    )
    # One extra neighbour, because a word is always nearest to itself.
    near = nearest_exact(vocabulary, asked, count + 1, decimals).where(F.col("id") != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy("rank")
    return (
        near.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= count)
        .select(F.col("query_id").alias("token"), "rank", F.col("id").alias("word"), "similarity")
    )


def query_terms(
    queries: DataFrame, expansions: DataFrame | None = None, lemmas: DataFrame | None = None
) -> DataFrame:
    """``query_id, term``: distinct words of the query and of its expansions.

    The query's own words and the expansions are prepared like document text, so
    an expansion of several words gives several terms. A query without any word
    keeps one empty term, which matches nothing.
    """
    empty = F.array(F.lit(""))
    words = content_words(F.col("query"))
    own = queries.select("query_id", F.explode(F.when(F.size(words) > 0, words).otherwise(empty)).alias("term"))
    if expansions is not None:
        added = expansions.select("query_id", F.explode(content_words(F.col("expansion"))).alias("term"))
        own = own.union(added)
    return lemmatise_words(own.distinct(), "term", lemmas).distinct()
