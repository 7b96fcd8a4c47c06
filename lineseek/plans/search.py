"""Hybrid search for a table of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineseek.functions.text import content_words, join_words
from lineseek.operators.keyword import bm25_scores, term_bucket, tfidf_scores, weighted_postings
from lineseek.operators.full_scan import every_pair
from lineseek.operators.lemmas import lemmatise
from lineseek.operators.pair_scan import candidate_pairs
from lineseek.operators.query import expand_similar_words, expand_synonyms, query_terms
from lineseek.operators.ranking import add_keyword, add_query, add_score, drop_outranked, score_pairs, top_results
from lineseek.operators.retrieval import best_documents, keyword_hits
from lineseek.operators.vectors import best_per_query
from lineseek.plans.build import Embed
from lineseek.session import broadcast_if_few, materialise
from lineseek.sources.index import Index, id_block, load_index

PAIRS_PER_TASK, TASKS_PER_CORE = 5_000, 8
NAMED_TERMS = 300
STRONG_HITS = 200_000  # best keyword hits sent along with the queries, over all of them, but one a query at least


def _query_vectors(queries: DataFrame, embed: Embed | None, lemmas: DataFrame | None) -> DataFrame:
    """``query_id, query, query_vec``; a query without a vector has similarity 0
    to everything."""
    if embed is not None:
        words = lemmatise(queries.select("query_id", content_words(F.col("query")).alias("words")), "words", lemmas)
        texts = words.select(F.col("query_id").alias("id"), join_words(F.col("words")).alias("text"))
        vectors = embed(texts).select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
        return queries.select("query_id", "query").join(vectors, "query_id", "left")
    if "query_vec" in queries.columns:
        return queries.select("query_id", "query", "query_vec")
    return queries.select("query_id", "query", F.lit(None).cast("array<float>").alias("query_vec"))


def _all_terms(
    index: Index, queries: DataFrame, synonyms: DataFrame | None, word_vectors: DataFrame | None, lemmas: DataFrame | None
) -> DataFrame:
    """``query_id, term`` of the queries and their expansions, and the bucket of the term in a stored index."""
    expansions = None
    if synonyms is not None:
        expansions = expand_synonyms(queries, synonyms)
    if word_vectors is not None:
        similar = expand_similar_words(queries, word_vectors)
        expansions = similar if expansions is None else expansions.union(similar)
    terms = query_terms(queries, expansions, lemmas)
    if index.term_buckets is not None:
        terms = terms.withColumn("term_bucket", term_bucket(F.col("term"), index.term_buckets))
    return terms


def keyword_scores(
    index: Index, queries: DataFrame, *, scoring: str = "tfidf", synonyms: DataFrame | None = None,
    word_vectors: DataFrame | None = None, lemmas: DataFrame | None = None,
) -> DataFrame:
    """``query_id, doc_id, score`` of documents sharing a term with a query."""
    terms = _all_terms(index, queries, synonyms, word_vectors, lemmas)
    n_terms = terms.count()
    if scoring == "tfidf":
        return tfidf_scores(terms, index.postings, index.terms, n_terms)
    if scoring == "bm25":
        return bm25_scores(terms, index.postings, index.terms, index.n_docs, index.avg_doc_len, n_terms)
    raise ValueError(f"unknown scoring: {scoring}")


def keyword_search(
    index: Index, queries: DataFrame, *, limit: int = 10, scoring: str = "tfidf", decimals: int | None = None, **expansion
) -> DataFrame:
    """``query_id, rank, id, score``: the best documents of each query by keywords alone, ties by id.

    ``expansion`` are the options ``synonyms``, ``word_vectors`` and ``lemmas`` of ``search``.
    """
    if limit < 0:
        raise ValueError("limit must not be negative")
    terms, n_terms, matched = _matched(index, queries, scoring, expansion)
    margin = 1e-9 if decimals is None else 10.0**-decimals
    found = best_documents(matched, terms, max(limit, 1), index.n_docs, n_terms, margin, n_terms)
    score = F.col("score") if decimals is None else F.round("score", decimals)
    return best_per_query(found.withColumn("score", score), "score", limit).select("query_id", "rank", "id", "score")


def _matched(index: Index, queries: DataFrame, scoring: str, expansion: dict) -> tuple[DataFrame, int, DataFrame]:
    """Terms of the queries, how many there are, and the weighted postings of all of them, both written once."""
    options = {name: expansion.get(name) for name in ("synonyms", "word_vectors", "lemmas")}
    terms = materialise(_all_terms(index, queries, **options), "terms")
    n_terms = terms.count()
    postings, known = index.postings, index.terms
    if n_terms <= NAMED_TERMS:  # named in the scan, they leave files and pages of other terms unread
        named = [row["term"] for row in terms.select("term").distinct().collect()]
        postings, known = (table.where(F.col("term").isin(named)) for table in (postings, known))
    weighted = weighted_postings(
        terms, postings, known, n_terms, scoring=scoring, n_docs=index.n_docs, avg_doc_len=index.avg_doc_len
    )
    return terms.select("query_id", "term"), n_terms, materialise(weighted, "matched")


def _strong_hits(matched: DataFrame, terms: DataFrame, n_docs: Column, n_queries: int, n_terms: int) -> DataFrame:
    """``query_id, id, keyword, weak, best``: relevances of the best keyword hits of each query, what any other
    document has at most, and the score that counts as 1."""
    k = max(1, STRONG_HITS // max(n_queries, 1))
    hits = materialise(keyword_hits(matched, terms, k, n_docs, n_queries, n_terms), "hits")
    ends = hits.groupBy("query_id").agg(
        F.max("score").alias("best"), F.when(F.count("*") >= k, F.min("score")).otherwise(0.0).alias("least")
    )
    joined = hits.join(broadcast_if_few(ends, n_queries), "query_id")
    return joined.select(
        "query_id", "id", (F.col("score") / F.col("best")).alias("keyword"),
        F.least(F.col("least") / F.col("best"), F.lit(1.0)).alias("weak"), "best",
    )


def pair_keyword(
    pairs: DataFrame, terms: DataFrame, matched: DataFrame, best: DataFrame, n_pairs: int, n_terms: int, n_queries: int
) -> DataFrame:
    """``query_id, id, keyword``: the exact relevance of each pair that shares a term. Few pairs come to the
    postings, which stay in place."""
    keys = pairs.select("query_id", "id")
    found = matched.join(broadcast_if_few(keys, n_pairs), F.col("doc_id") == F.col("id"))
    shared = found.join(broadcast_if_few(terms, n_terms), ["query_id", "term"])
    scores = shared.groupBy("query_id", "id").agg(F.sum("weight").alias("score"))
    return scores.join(broadcast_if_few(best, n_queries), "query_id").select(
        "query_id", "id", (F.col("score") / F.col("best")).alias("keyword")
    )


def _rated(
    found: DataFrame, texts: DataFrame, terms: DataFrame, matched: DataFrame, hits: DataFrame, n_terms: int, n_queries: int
) -> DataFrame:
    """Pairs of the scan with their query and exact keyword relevance."""
    pairs = materialise(found, "pairs")
    n_pairs = pairs.count()
    # Edit distances cost far more than the bytes of a pair: deal them out evenly,
    # to a few tasks per core.
    cores = pairs.sparkSession.sparkContext.defaultParallelism
    tasks = min(n_pairs // PAIRS_PER_TASK + 1, TASKS_PER_CORE * cores)
    dealt = pairs.repartition(tasks, "query_id", "id")
    best = hits.groupBy("query_id").agg(F.max("best").alias("best"))
    keyword = pair_keyword(pairs, terms, matched, best, n_pairs, n_terms, n_queries)
    return add_query(add_keyword(dealt, keyword), texts, n_queries)


def score_all(
    index: Index, queries: DataFrame, *, semantic_weight: float = 0.7, title_weight: float = 0.3,
    scoring: str = "tfidf", decimals: int | None = None,
) -> DataFrame:
    """``query_id, id, title, score`` and its parts for every query and document, to look at how scores
    are distributed. As many rows as pairs: unlike ``search``, nothing is left out."""
    vectors = materialise(_query_vectors(queries, None, None), "queries")
    texts = vectors.select("query_id", F.coalesce("query", F.lit("")).alias("query"))
    n_queries = texts.count()
    terms, n_terms, matched = _matched(index, texts, scoring, {})
    best = keyword_hits(matched, terms, 1, index.n_docs, n_queries, n_terms).select("query_id", F.col("score").alias("best"))
    copies = vectors.groupBy("query_id").agg(F.count("*").alias("copies"))
    asked = texts.join(vectors.select("query_id", "query_vec"), "query_id").join(copies, "query_id").join(best, "query_id", "left")
    rated = every_pair(index.signals, asked, terms, matched, index.n_docs, n_queries)
    return add_score(rated, semantic_weight, title_weight, decimals).select(
        "query_id", "id", "title", "score", "semantic_similarity", "keyword_relevance", "title_relevance", "title_match"
    )


def search(
    index: Index,
    queries: DataFrame,
    *,
    limit: int | None = 10,
    threshold: float | None = 0.5,
    semantic_weight: float = 0.7,
    title_weight: float = 0.3,
    scoring: str = "tfidf",
    synonyms: DataFrame | None = None,
    word_vectors: DataFrame | None = None,
    lemmas: DataFrame | None = None,
    embed: Embed | None = None,
    decimals: int | None = None,
) -> DataFrame:
    """Ranked documents for ``queries(query_id, query[, query_vec])``.

    ``decimals`` rounds scores before the threshold and the ranking; ties then
    fall to the lower id whatever order partial sums arrived in. ``limit=None``
    returns everything at or above the threshold, without a rank.
    """
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    # Written once: vectors may come from a model or another source that can't repeat itself.
    vectors = materialise(_query_vectors(queries, embed, lemmas), "queries")
    texts = vectors.select("query_id", F.coalesce("query", F.lit("")).alias("query"))
    n_queries = texts.count()
    margin = 1e-9 if decimals is None else 10.0**-decimals
    terms, n_terms, matched = _matched(
        index, texts, scoring, {"synonyms": synonyms, "word_vectors": word_vectors, "lemmas": lemmas}
    )
    hits = _strong_hits(matched, terms, index.n_docs, n_queries, n_terms)
    documents, ids = index.signals.agg(F.count("*"), F.count_distinct("id")).first()
    found = candidate_pairs(
        index.signals,
        vectors,
        repeated_ids=documents != ids or n_queries != texts.agg(F.count_distinct("query_id")).first()[0],
        semantic_weight=semantic_weight,
        title_weight=title_weight,
        keyword_weight=1.0 - semantic_weight,
        hits=hits,
        n_queries=n_queries,
        threshold=threshold,
        limit=limit,
        margin=margin,
    ).drop("at_least")
    rated = _rated(found, texts, terms, matched, hits, n_terms, n_queries)
    if limit:
        rated = drop_outranked(rated, limit, semantic_weight, title_weight, margin, n_queries)
    scored = score_pairs(rated, semantic_weight, title_weight, decimals)
    n_results = None if limit is None else limit * n_queries
    return _with_documents(top_results(scored, threshold, limit), index, n_results)


def _with_documents(results: DataFrame, index: Index, n_results: int | None) -> DataFrame:
    """Fetches content and original entry of the results.

    Results known to be few are sent to the entries, which are then read only in
    the id ranges that hold a result; otherwise it is an ordinary join.
    """
    keys = ["id"]
    if index.docs_per_block is not None:
        results = results.withColumn("id_block", id_block(F.col("id"), index.docs_per_block))
        keys = ["id_block", "id"]
    documents = index.entries.select(*keys, "content", "original_entry")
    return documents.join(broadcast_if_few(results, n_results), keys).select(
        "query_id",
        "rank",
        "id",
        "title",
        "content",
        "score",
        F.col("score").alias("relevance"),
        "semantic_similarity",
        "keyword_relevance",
        "title_relevance",
        "original_entry",
    )


def search_index(spark: SparkSession, queries: DataFrame | str, index_dir: str = "./index", **options) -> DataFrame:
    """``search`` over a stored index; a single query may be given as a string."""
    index = load_index(spark, index_dir)
    if isinstance(queries, str):
        queries = spark.createDataFrame([(0, queries)], "query_id bigint, query string")
    return search(index, queries, **options)
