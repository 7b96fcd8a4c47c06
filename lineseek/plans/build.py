"""From documents to search tables, in memory or on disk."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineseek.functions.text import content_words, join_words
from lineseek.operators.keyword import document_frequency, postings
from lineseek.operators.lemmas import lemmatise
from lineseek.operators.vectors import DEFAULT_DIM, attach_vectors
from lineseek.session import materialise, remove, scratch_run
from lineseek.sources import index as store
from lineseek.sources.jsonl import read_documents

Embed = Callable[[DataFrame], DataFrame]  # (id, text) -> (id, vec)


def tokenised(documents: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """Adds ``content_tokens`` and ``title_tokens`` to ``title, content``."""
    words = documents.withColumn("content_tokens", content_words(F.col("content"))).withColumn(
        "title_tokens", content_words(F.col("title"))
    )
    return words if lemmas is None else _lemmatised(words, lemmas)


def _lemmatised(words: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Both token arrays as one, so that rows are written and joined once."""
    kept = [name for name in words.columns if name not in ("content_tokens", "title_tokens")]
    both = words.select(
        *kept, F.concat("content_tokens", "title_tokens").alias("_both"), F.size("content_tokens").alias("_content")
    )
    rest = F.size("_both") - F.col("_content")
    return lemmatise(both, "_both", lemmas).select(
        *kept,
        F.slice("_both", F.lit(1), F.col("_content")).alias("content_tokens"),
        F.slice("_both", F.col("_content") + 1, rest).alias("title_tokens"),
    )


def _processed(documents: DataFrame, lemmas: DataFrame | None) -> DataFrame:
    return (
        tokenised(documents, lemmas)
        .withColumn("processed_title", join_words(F.col("title_tokens")))
        .withColumn("processed_content", join_words(F.col("content_tokens")))
        .drop("content_tokens", "title_tokens")
    )


def signals_of(
    entries: DataFrame, content_vectors: DataFrame | None, title_vectors: DataFrame | None,
    title_boost: bool, dim: int,
) -> DataFrame:
    """``id, title, content_vec, title_vec``. Contents stay out of this join, so
    only ids, titles and vectors move."""
    signals = attach_vectors(entries.select("id", "title"), content_vectors, "content_vec", dim=dim)
    if title_boost:
        return attach_vectors(signals, title_vectors, "title_vec", dim=dim)
    return signals.withColumn("title_vec", F.lit(None).cast("array<float>"))


def index_tables(
    documents: DataFrame,
    content_vectors: DataFrame | None = None,
    title_vectors: DataFrame | None = None,
    *,
    title_boost: bool = True,
    dim: int = DEFAULT_DIM,
    lemmas: DataFrame | None = None,
) -> store.Index:
    """An index for one session over ``documents(id, title, content, original_entry)``.

    The postings are written to the shared folder, because document frequencies
    and matches both read them and the texts should be taken apart once.
    """
    words = tokenised(documents.select("id", "title", "content")).drop("title", "content")
    if lemmas is not None:  # no text goes along where tokens are joined
        words = _lemmatised(words, lemmas)
    posted = materialise(postings(words), "postings")
    n_docs = documents.agg(F.count("*")).scalar()
    return store.Index(
        entries=documents,
        signals=signals_of(documents, content_vectors, title_vectors, title_boost, dim),
        postings=posted,
        terms=document_frequency(posted, n_docs),
        n_docs=n_docs,
        avg_doc_len=posted.agg(F.sum("tf")).scalar() / n_docs,
    )


def save_index(
    documents: DataFrame,
    output_dir: str,
    *,
    content_vectors: DataFrame | None = None,
    title_vectors: DataFrame | None = None,
    embed: Embed | None = None,
    title_boost: bool = True,
    dim: int = DEFAULT_DIM,
    lemmas: DataFrame | None = None,
    source_file: str = "",
    content_field: str = "content",
    title_field: str = "title",
    model: str = "",
) -> str:
    """Writes the index of ``documents(id, title, content, original_entry)``.

    Vectors come from the given tables ``(id, vec)`` or from ``embed``, which maps
    processed texts to vectors; texts without a vector get zeros. Entries are
    written first and every later table is derived from the stored ones, so
    texts are prepared once. The metadata row comes last and puts the build in
    force; a build that fails leaves the one before as it was.
    """
    spark = documents.sparkSession
    build = store.new_build(output_dir)
    try:
        with scratch_run(spark):
            n_docs = documents.count()
            entries = store.write_entries(_processed(documents, lemmas), build, n_docs)
            if embed is not None:
                content_vectors = embed(entries.select("id", F.col("processed_content").alias("text")))
                if title_boost:
                    title_vectors = embed(entries.select("id", F.col("processed_title").alias("text")))
            signals = store.write_signals(
                signals_of(entries, content_vectors, title_vectors, title_boost, dim), build
            )
            posted = store.write_postings(entries, build, n_docs)
            terms = store.write_terms(posted, build, n_docs)
            words = posted.agg(F.sum("tf")).first()[0] or 0
    except Exception:
        remove(spark, build)
        raise
    written = {"entries": entries, "signals": signals, "postings": posted, "terms": terms}
    store.publish(
        spark, output_dir, build, {name: table.schema for name, table in written.items()},
        source_file=source_file, content_field=content_field, title_field=title_field, model=model,
        title_boost=title_boost, entry_count=n_docs, avg_doc_len=words / n_docs if n_docs else 0.0,
    )
    return output_dir


def build_index(
    spark: SparkSession,
    path: str,
    output_dir: str = "./index",
    *,
    content_field: str = "content",
    title_field: str = "title",
    model: str = "universal-sentence-encoder",
    title_boost: bool = True,
    content_vectors: DataFrame | None = None,
    title_vectors: DataFrame | None = None,
    embed: Embed | None = None,
    dim: int = DEFAULT_DIM,
    lemmas: DataFrame | None = None,
) -> str:
    """Builds the index of a JSON-lines file or folder and returns its folder.

    ``model`` is a label kept in the metadata.
    """
    with scratch_run(spark):
        documents = read_documents(spark, path, content_field, title_field)
        return save_index(
            documents,
            output_dir,
            content_vectors=content_vectors,
            title_vectors=title_vectors,
            embed=embed,
            title_boost=title_boost,
            dim=dim,
            lemmas=lemmas,
            source_file=path.rstrip("/").rsplit("/", 1)[-1],
            content_field=content_field,
            title_field=title_field,
            model=model,
        )
