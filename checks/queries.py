"""Registered queries: every operator run over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import corpus
from lineseek.functions.text import content_words, join_words, normalise, remove_stopwords, tokenise
from lineseek.functions.vectors import cosine_similarity
from lineseek.operators.keyword import document_frequency, keyword_relevance, postings
from lineseek.operators.lemmas import lemmatise
from lineseek.operators.profile import profile_entries
from lineseek.operators.query import expand_synonyms, nearest_words, query_terms
from lineseek.operators.ranking import best_titles, result_view
from lineseek.operators.vectors import (
    attach_vectors,
    embed_texts,
    hashed_vectors,
    nearest_approx,
    nearest_exact,
    train_word_vectors,
    word_vectors,
)
from lineseek.operators.word_space import embed_by_words, word_space
from lineseek.plans.analyze import analyze
from lineseek.plans.build import build_index, save_index, signals_of, tokenised
from lineseek.plans.search import keyword_scores, keyword_search, score_all, search, search_index
from lineseek.session import materialise
from lineseek.sources.index import load_index, read_metadata
from lineseek.sources.jsonl import dataset_size, entries_of, read_documents, rejected_lines

DECIMALS = 6
LIMIT = 10
NEAR = 0.25


def _r(column: str) -> F.Column:
    return F.round(F.col(column), DECIMALS).alias(column)


# -- text ----------------------------------------------------------------------

def normalise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "documents").select("doc_id", normalise(F.col("text")).alias("normalised"))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "documents").select("doc_id", tokenise(F.col("text")).alias("tokens"))


def _joined(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.size("tokens").alias("n_tokens"), join_words(F.col("tokens")).alias("tokens"))


def tokenise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(_words(spark, sf_dir))


def remove_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(_words(spark, sf_dir).withColumn("tokens", remove_stopwords(F.col("tokens"))))


def lemmatise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(lemmatise(_words(spark, sf_dir), "tokens", corpus.lemmas(spark, sf_dir)))


def preprocess_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = content_words(F.col("text"))
    return corpus.table(spark, sf_dir, "documents").select("doc_id", join_words(words).alias("processed"))


# -- keywords ------------------------------------------------------------------

def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings(tokenised(corpus.documents(spark, sf_dir)))


def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _postings(spark, sf_dir)


def doc_freq_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_docs = corpus.table(spark, sf_dir, "documents").agg(F.count("*")).scalar()
    return document_frequency(_postings(spark, sf_dir), n_docs).select("term", "df", _r("idf"))


def _tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword_scores(corpus.index(spark, sf_dir), corpus.queries(spark, sf_dir))


def tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tfidf(spark, sf_dir).select("query_id", "doc_id", _r("score"))


def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_queries = corpus.queries(spark, sf_dir).count()
    return keyword_relevance(_tfidf(spark, sf_dir), n_queries).select("query_id", "doc_id", _r("keyword_relevance"))


def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = keyword_scores(corpus.index(spark, sf_dir), corpus.queries(spark, sf_dir), scoring="bm25")
    return scores.select("query_id", "doc_id", _r("score"))


def keyword_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword_search(corpus.index(spark, sf_dir), corpus.queries(spark, sf_dir), limit=LIMIT, decimals=DECIMALS)


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, asked = corpus.index(spark, sf_dir), corpus.queries(spark, sf_dir)
    return keyword_search(index, asked, limit=LIMIT, scoring="bm25", decimals=DECIMALS)


# -- vectors -------------------------------------------------------------------

def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals_of(
        corpus.documents(spark, sf_dir), corpus.content_vectors(spark, sf_dir), corpus.title_vectors(spark, sf_dir),
        title_boost=True, dim=corpus.DIM,
    )


def attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    def total(vec: str) -> F.Column:
        return F.aggregate(vec, F.lit(0.0), lambda t, x: t + x.cast("double"))

    return _signals(spark, sf_dir).select(
        "id",
        F.size("content_vec").alias("content_dim"),
        F.round(total("content_vec"), DECIMALS).alias("content_sum"),
        F.round(total("title_vec"), DECIMALS).alias("title_sum"),
    )


def cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir).select(
        "id", F.round(cosine_similarity(F.col("content_vec"), F.col("title_vec")), DECIMALS).alias("similarity")
    )


def _document_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = corpus.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return attach_vectors(ids, corpus.content_vectors(spark, sf_dir), "vec", dim=corpus.DIM)


def exact_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = corpus.queries(spark, sf_dir)
    return nearest_exact(_document_vectors(spark, sf_dir), asked, LIMIT, decimals=DECIMALS)


def approx_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_approx(_document_vectors(spark, sf_dir), corpus.queries(spark, sf_dir), LIMIT)


def hashed_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = preprocess_text(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("processed").alias("text"))
    weighted = F.aggregate(
        F.transform("vec", lambda x, place: x.cast("double") * (place + 1)), F.lit(0.0), lambda total, x: total + x
    )
    return hashed_vectors(texts, dim=corpus.DIM).select("id", F.size("vec").alias("dim"), F.round(weighted, 3).alias("weighted"))


def _word_model(spark: SparkSession, sf_dir: str):
    texts = corpus.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), content_words(F.col("text")).alias("words")
    )
    return train_word_vectors(texts, "words", dim=32, min_count=5)


def word2vec_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = preprocess_text(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("processed").alias("text"))
    return embed_texts(_word_model(spark, sf_dir), texts)


def similar_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = corpus.table(spark, sf_dir, "benchmark").select(
        F.explode(content_words(F.col("text"))).alias("token")
    ).distinct()
    return nearest_words(asked, word_vectors(_word_model(spark, sf_dir)))


SPACE_DIM = 16


def _word_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = corpus.table(spark, sf_dir, "documents").select(content_words(F.col("text")).alias("words"))
    return word_space(texts, "words", dim=SPACE_DIM)


def cooccurrence_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of each text's vector."""
    texts = preprocess_text(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("processed").alias("text"))
    embedded = embed_by_words(_word_space(spark, sf_dir), texts, dim=SPACE_DIM)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda total, x: total + x * x))
    return embedded.select("id", F.round(norm, 5).alias("norm"))


def cooccurrence_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = corpus.table(spark, sf_dir, "benchmark").select(
        F.explode(content_words(F.col("text"))).alias("token")
    ).distinct()
    return nearest_words(asked, _word_space(spark, sf_dir), decimals=DECIMALS)


# -- queries -------------------------------------------------------------------

def synonym_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expand_synonyms(corpus.queries(spark, sf_dir), corpus.synonyms(spark, sf_dir))


def all_query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_terms(corpus.queries(spark, sf_dir), synonym_expansion(spark, sf_dir))


# -- ranking -------------------------------------------------------------------

def title_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The titles closest to each query, of all titles."""
    titles, asked = corpus.documents(spark, sf_dir).select("id", "title"), corpus.queries(spark, sf_dir)
    return best_titles(titles, asked, LIMIT, decimals=DECIMALS)


def _search(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return search(corpus.index(spark, sf_dir), corpus.queries(spark, sf_dir), decimals=DECIMALS, **options)


def _scores(results: DataFrame) -> DataFrame:
    parts = ("semantic_similarity", "keyword_relevance", "title_relevance")
    return results.select("query_id", "id", "title", "score", *[_r(part) for part in parts])


def hybrid_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a query and a document, summed up by query, and those at or above ``NEAR`` as rows."""
    scored = score_all(corpus.index(spark, sf_dir), corpus.queries(spark, sf_dir), decimals=DECIMALS)

    def total(column: str, name: str) -> F.Column:
        return F.round(F.sum(column), 3).alias(name)

    parts = ("semantic_similarity", "keyword_relevance", "title_relevance")
    pair = F.struct("id", F.col("title").alias("document_title"), "score", *parts)
    sums = ("score", *parts, "title_match")
    # Pairs are worked out once: what isn't a row of its own is summed up in the tasks.
    summed = materialise(
        scored.groupBy("query_id", F.when(F.col("score") >= NEAR, pair).alias("near")).agg(
            F.count("*").alias("pairs"), F.min("score").alias("least"), F.max("score").alias("most"),
            *(F.sum(name).alias(name) for name in sums),
        ),
        "near",
    )
    totals = summed.groupBy("query_id").agg(
        F.sum("pairs").alias("pairs"), total("score", "total"),
        F.round(F.min("least"), 5).alias("least"), F.round(F.max("most"), 5).alias("most"),
        total("semantic_similarity", "semantic"), total("keyword_relevance", "keyword"),
        total("title_relevance", "title"), total("title_match", "title_match"),
    )
    near = summed.where(F.col("near").isNotNull()).select(
        "query_id", F.explode(F.array_repeat("near", F.col("pairs").cast("int"))).alias("near")
    )
    rows = near.select("query_id", "near.id", "near.document_title", "near.score", *(_r(f"near.{part}").alias(part) for part in parts))
    return totals.join(rows, "query_id", "left")


def hybrid_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(_search(spark, sf_dir, threshold=0.5, limit=None))


def _ranked(results: DataFrame) -> DataFrame:
    return results.select("query_id", "rank", "id", "score", "relevance")


def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(_search(spark, sf_dir, threshold=None, limit=LIMIT))


def search_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result_view(_search(spark, sf_dir, threshold=0.1, limit=LIMIT))


def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(_search(spark, sf_dir, threshold=0.1, limit=LIMIT, scoring="bm25"))


def expanded_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    synonyms = corpus.synonyms(spark, sf_dir)
    return _ranked(_search(spark, sf_dir, threshold=0.1, limit=LIMIT, synonyms=synonyms))


def search_no_title_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = corpus.index(spark, sf_dir, title_boost=False)
    return _ranked(search(index, corpus.queries(spark, sf_dir), threshold=None, limit=LIMIT, decimals=DECIMALS))


def search_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(_search(spark, sf_dir, threshold=None, limit=LIMIT, semantic_weight=0.5, title_weight=0.6))


def search_lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    lemmas = corpus.lemmas(spark, sf_dir)
    index = corpus.index(spark, sf_dir, lemmas=lemmas)
    asked = corpus.queries(spark, sf_dir)
    return _ranked(search(index, asked, threshold=None, limit=LIMIT, decimals=DECIMALS, lemmas=lemmas))


# -- profile -------------------------------------------------------------------

def _profile(lines: DataFrame, **options) -> DataFrame:
    return profile_entries(entries_of(lines), **options)[0]


def profile_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.table(spark, sf_dir, "documents")
    lines = rows.select(F.col("doc_id").alias("pos"), F.to_json(F.struct(*rows.columns)).alias("line"))
    return _profile(lines)


def _props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.col("props").alias("line"))


def profile_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(_props(spark, sf_dir))


def profile_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(corpus.typed_lines(spark, sf_dir))


def profile_fields_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(corpus.typed_lines(spark, sf_dir), fields=["event", "value", "absent"])


def profile_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(corpus.typed_lines(spark, sf_dir), sample_size=500)


# -- files ---------------------------------------------------------------------

def jsonl_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(spark, corpus.written_lines(spark, sf_dir)).select("id", "title", "content")


def jsonl_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected_lines(corpus.json_lines(spark, sf_dir)).select("pos", "reason")


def size_of_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset_size(spark, corpus.written_lines(spark, sf_dir))


def analyze_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to report: fields with the totals of the collection."""
    report = analyze(spark, corpus.written_lines(spark, sf_dir))
    totals = report.summary.select("total_entries", "file_size").first()
    return report.fields.select("*", *(F.lit(totals[name]).alias(name) for name in ("total_entries", "file_size")))


def lines_to_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to stored index to results, by text alone."""
    index_dir = build_index(spark, corpus.written_lines(spark, sf_dir), corpus.scratch(spark, "lines-index"), dim=corpus.DIM)
    asked = corpus.queries(spark, sf_dir).select("query_id", "query")
    return _ranked(search_index(spark, asked, index_dir, threshold=None, limit=LIMIT, decimals=DECIMALS))


def _saved_index(spark: SparkSession, sf_dir: str) -> str:
    return save_index(
        corpus.documents(spark, sf_dir),
        corpus.scratch(spark, "index"),
        content_vectors=corpus.content_vectors(spark, sf_dir),
        title_vectors=corpus.title_vectors(spark, sf_dir),
        dim=corpus.DIM,
        source_file="documents.parquet",
        model="stored vectors",
    )


def index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = load_index(spark, _saved_index(spark, sf_dir))
    return _ranked(search(index, corpus.queries(spark, sf_dir), threshold=None, limit=LIMIT, decimals=DECIMALS))


def index_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_metadata(spark, _saved_index(spark, sf_dir)).select(
        "source_file", "content_field", "title_field", "model", "title_boost", "entry_count", _r("avg_doc_len")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "normalise_text": normalise_text,
    "tokenise": tokenise_text,
    "remove_stopwords": remove_stop,
    "lemmatise": lemmatise_text,
    "preprocess_text": preprocess_text,
    "term_counts": term_counts,
    "doc_freq_idf": doc_freq_idf,
    "tfidf_scores": tfidf,
    "keyword_relevance": relevance,
    "bm25_scores": bm25,
    "keyword_topk": keyword_topk,
    "bm25_topk": bm25_topk,
    "attach_vectors": attach,
    "cosine_similarity": cosine,
    "nearest_exact": exact_neighbours,
    "nearest_approx": approx_neighbours,
    "word2vec_embed": word2vec_embed,
    "nearest_words": similar_words,
    "cooccurrence_embed": cooccurrence_embed,
    "cooccurrence_words": cooccurrence_words,
    "expand_synonyms": synonym_expansion,
    "query_terms": all_query_terms,
    "title_similarity": title_similarity,
    "hybrid_score": hybrid_score,
    "hybrid_threshold": hybrid_threshold,
    "hybrid_topk": hybrid_topk,
    "search_view": search_view,
    "bm25_search": bm25_search,
    "expanded_search": expanded_search,
    "search_no_title_boost": search_no_title_boost,
    "search_weights": search_weights,
    "search_lemmas": search_lemmas,
    "hashed_embed": hashed_embed,
    "analyze_files": analyze_files,
    "lines_to_search": lines_to_search,
    "profile_documents": profile_documents,
    "profile_props": profile_props,
    "profile_types": profile_types,
    "profile_fields_filter": profile_fields_filter,
    "profile_sample": profile_sample,
    "jsonl_extract": jsonl_extract,
    "jsonl_rejects": jsonl_rejects,
    "dataset_size": size_of_dataset,
    "index_roundtrip": index_roundtrip,
    "index_metadata": index_metadata,
}
