"""Keyword index and scores: term counts, document frequency, TF-IDF, BM25.

Fixed definitions: tf is the raw count of a term in the weighted document text,
idf = 1 + ln(N / (1 + df)), and a query scores the sum of tf * idf over its
distinct terms. BM25 is the published Okapi formula with k1 = 1.2, b = 0.75.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineseek.session import broadcast_if_few, let

TITLE_REPEATS = 3  # title words count this many times in the keyword index
K1, B = 1.2, 0.75


def weighted_tokens(content_tokens: Column, title_tokens: Column) -> Column:
    """Content words followed by the title words, repeated."""
    return F.concat(content_tokens, F.flatten(F.array_repeat(title_tokens, TITLE_REPEATS)))


def count_tokens(tokens: Column) -> Column:
    """``array<struct<term, tf>>`` of one token array.

    Counts run lengths of the sorted tokens. A document is one row, so counting
    inside the row needs no shuffle; grouping (document, term) pairs would move
    every pair across the network.
    """

    def runs(words: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(words))
        first_of_run = F.filter(
            places, lambda i: (i == 1) | (F.get(words, i - 1) != F.get(words, i - 2))
        )
        return let(first_of_run, lambda starts: lengths(words, starts))

    def lengths(words: Column, starts: Column) -> Column:
        end = F.size(words) + 1
        return F.transform(
            starts,
            lambda start, k: F.struct(
                F.get(words, start - 1).alias("term"),
                (F.coalesce(F.get(starts, k + 1), end) - start).cast("bigint").alias("tf"),
            ),
        )

    return F.when(F.size(tokens) > 0, let(F.sort_array(tokens), runs))


def postings(documents: DataFrame) -> DataFrame:
    """``doc_id, term, tf, doc_len`` from ``id, content_tokens, title_tokens``."""
    weighted = documents.select(
        F.col("id").alias("doc_id"), weighted_tokens(F.col("content_tokens"), F.col("title_tokens")).alias("words")
    )
    return weighted.select(
        "doc_id", F.size("words").cast("bigint").alias("doc_len"), F.inline(count_tokens(F.col("words")))
    ).select("doc_id", "term", "tf", "doc_len")


def document_frequency(postings_table: DataFrame, n_docs: Column) -> DataFrame:
    """``term, df, idf``; counts combine before the shuffle."""
    counted = postings_table.groupBy("term").agg(F.count("*").alias("df"))
    return counted.withColumn("idf", 1 + F.log(n_docs / (1 + F.col("df"))))


def term_bucket(term: Column, buckets: int) -> Column:
    """Partition of the stored postings that holds a term."""
    return F.pmod(F.hash(term), F.lit(buckets))


def _matches(
    query_terms: DataFrame, postings_table: DataFrame, terms: DataFrame, n_terms: int | None
) -> DataFrame:
    """One row per (query, document, shared term).

    The query side is looked up in ``terms`` first, so only terms that exist reach
    the postings. With at most ``n_terms`` rows known to be few it is broadcast
    to both tables, which stay in place however often a term occurs; otherwise
    adaptive execution splits hot terms of a shuffled join. Where the tables
    carry ``term_bucket``, both scans are limited to the partitions of the
    queried terms.
    """
    keys = [k for k in ("term_bucket", "term") if k in query_terms.columns and k in postings_table.columns]
    asked = broadcast_if_few(query_terms.where(F.col("term") != "").distinct(), n_terms)
    known = broadcast_if_few(terms.join(asked, keys), n_terms)
    return postings_table.join(known, keys)


def _tfidf_weight() -> Column:
    return F.col("tf") * F.col("idf")


def _bm25_weight(n_docs: Column, avg_doc_len: Column) -> Column:
    tf, df = F.col("tf"), F.col("df")
    rarity = F.log(1 + (n_docs - df + 0.5) / (df + 0.5))
    return rarity * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("doc_len") / avg_doc_len)))


def weighted_postings(
    query_terms: DataFrame,
    postings_table: DataFrame,
    terms: DataFrame,
    n_terms: int | None = None,
    *,
    scoring: str = "tfidf",
    n_docs: Column | None = None,
    avg_doc_len: Column | None = None,
) -> DataFrame:
    """``term, doc_id, weight`` of every posting of a term that any query asks for, once
    whatever number of queries does; a query scores the sum over its terms."""
    weight = term_weight(scoring, n_docs, avg_doc_len)
    keys = [k for k in ("term_bucket", "term") if k in query_terms.columns]
    matches = _matches(query_terms.select(*keys), postings_table, terms, n_terms)
    return matches.select("term", "doc_id", weight.cast("double").alias("weight"))


def term_weight(scoring: str, n_docs: Column | None, avg_doc_len: Column | None) -> Column:
    if scoring == "tfidf":
        return _tfidf_weight()
    if scoring == "bm25":
        return _bm25_weight(n_docs, avg_doc_len)
    raise ValueError(f"unknown scoring: {scoring}")


def tfidf_scores(
    query_terms: DataFrame, postings_table: DataFrame, terms: DataFrame, n_terms: int | None = None
) -> DataFrame:
    """``query_id, doc_id, score`` for every pair sharing a term; others score 0.

    ``n_terms`` is the number of query term rows, or a bound on it, if known.
    """
    matches = _matches(query_terms, postings_table, terms, n_terms)
    return matches.groupBy("query_id", "doc_id").agg(F.sum(_tfidf_weight()).alias("score"))


def bm25_scores(
    query_terms: DataFrame,
    postings_table: DataFrame,
    terms: DataFrame,
    n_docs: Column,
    avg_doc_len: Column,
    n_terms: int | None = None,
) -> DataFrame:
    """``query_id, doc_id, score`` by Okapi BM25 over the same matches."""
    matches = _matches(query_terms, postings_table, terms, n_terms)
    return matches.groupBy("query_id", "doc_id").agg(F.sum(_bm25_weight(n_docs, avg_doc_len)).alias("score"))


def keyword_relevance(scores: DataFrame, n_queries: int | None = None) -> DataFrame:
    """Adds ``keyword_relevance``: the score over the query's best score.

    The maximum is one row per query. It is joined back, by broadcast if the
    number of queries is known to be small, so the scores of a query are never
    gathered in one place.
    """
    best = scores.groupBy("query_id").agg(F.max("score").alias("best"))
    share = F.col("score") / F.coalesce(F.nullif(F.col("best"), F.lit(0.0)), F.lit(1.0))
    joined = scores.join(broadcast_if_few(best, n_queries), "query_id")
    return joined.withColumn("keyword_relevance", share).drop("best")
