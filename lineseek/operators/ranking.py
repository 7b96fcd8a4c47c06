"""Hybrid scoring, threshold, top-k and the printable result view."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineseek.functions.numbers import to_fixed
from lineseek.operators.edit_distance import Titles, code_points
from lineseek.operators.pair_scan import FEW_QUERIES, QUERIES_PER_SCAN, pack_rows, read_rows
from lineseek.operators.vectors import best_per_query
from lineseek.session import broadcast_if_few, materialise

# Tasks get the functions below themselves, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SNIPPET = 200
SAMPLE_SHARE = 64  # one title of so many is compared first
TASKS_PER_CORE = 4


def title_match(query: Column, title: Column) -> Column:
    """Share of characters that need no edit: (L - distance) / L on lower-cased
    text, L being the longer length. An empty title matches nothing.

    This definition (normalised Levenshtein) is fixed by this package.
    """
    left, right = F.lower(query), F.lower(title)
    longer = F.greatest(F.char_length(left), F.char_length(right))
    return F.when(F.char_length(right) > 0, (longer - F.levenshtein(left, right)) / longer).otherwise(0.0)


def best_titles(documents: DataFrame, queries: DataFrame, limit: int, decimals: int | None = None) -> DataFrame:
    """``query_id, rank, id, title_match``: of all titles, those closest to each query, ties by id.

    ``documents`` has ``id, title``, ``queries`` has ``query_id, query``. A task compares a query with
    many titles at once and lets go of what ``limit`` others beat, or of whole groups whose lengths rule
    that out; one title of ``SAMPLE_SHARE`` tells first what ``limit`` titles reach for sure. Only titles
    move, to be dealt out evenly; few queries are sent to all tasks.
    """
    if limit < 0:
        raise ValueError("limit must not be negative")
    n_queries = queries.count()
    title = documents.select("id", F.lower(F.coalesce("title", F.lit(""))).alias("title"))
    asked = queries.select("query_id", F.lower(F.coalesce("query", F.lit(""))).alias("query"))
    margin = 1e-9 if decimals is None else 10.0**-decimals
    k = max(limit, 1)
    id_type, query_type = title.schema["id"].dataType.simpleString(), asked.schema["query_id"].dataType.simpleString()

    def closest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                asked = pa.RecordBatch.from_struct_array(batch.column("queries")[i].values)
                points = [code_points(text).tolist() for text in asked.column("query").to_pylist()]
                alphabet = np.unique(np.array([point for text in points for point in text], np.uint32))
                rows = read_rows(batch.column("documents")[i]).combine_chunks()
                rows = rows.take(pc.array_sort_indices(rows.column("id"), null_placement="at_start"))
                titles = Titles(rows.column("title").combine_chunks(), alphabet)
                ids = rows.column("id").combine_chunks()
                # Of equal titles, those of the ``k`` least ids.
                holders = np.argsort(titles.place, kind="stable")
                starts = np.searchsorted(titles.place[holders], np.arange(len(titles.texts)))
                counts = np.diff(np.append(starts, len(holders)))
                floor = asked.column("floor").to_numpy()
                best = tops.setdefault(batch.column("query_block")[i].as_py(), np.repeat(floor[:, None], k, axis=1))
                for q, query in enumerate(points):
                    order = sorted(range(len(titles.groups)), key=lambda g: -titles.bound(len(query), g))
                    for number in order:
                        if titles.bound(len(query), number) < best[q].min() - margin:
                            break
                        group, share = titles.groups[number], titles.group_matches(query, number)
                        each = np.repeat(share, np.minimum(counts[group], k))
                        best[q] = np.partition(np.concatenate([best[q], each]), -k)[-k:]
                        kept = np.flatnonzero(share >= best[q].min() - margin)
                        at = np.concatenate([holders[starts[j] : starts[j] + min(counts[j], k)] for j in group[kept]] or [[]])
                        times = np.minimum(counts[group[kept]], k)
                        if len(at):
                            yield pa.RecordBatch.from_arrays(
                                [
                                    asked.column("query_id").take(pa.array(np.full(len(at), q))),
                                    ids.take(pa.array(at.astype(np.int64))),
                                    pa.array(np.repeat(share[kept], times)),
                                ],
                                names=["query_id", "id", "share"],
                            )

    def ranked(title: DataFrame, asked: DataFrame, tasks: int) -> DataFrame:
        packed = title.repartition(tasks).mapInArrow(pack_rows, "documents binary")
        block = F.pmod(F.xxhash64("query_id"), F.lit(n_queries // QUERIES_PER_SCAN + 1)).alias("query_block")
        blocks = asked.groupBy(block).agg(F.collect_list(F.struct("query_id", "query", "floor")).alias("queries"))
        blocks = F.broadcast(blocks) if n_queries <= FEW_QUERIES else materialise(blocks, "query-blocks")
        found = packed.crossJoin(blocks).mapInArrow(closest, f"query_id {query_type}, id {id_type}, share double")
        share = F.col("share") if decimals is None else F.round("share", decimals)
        return best_per_query(found.select("query_id", "id", share.alias("title_match")), "title_match", limit)

    cores = title.sparkSession.sparkContext.defaultParallelism
    open_ = asked.withColumn("floor", F.lit(-1.0))
    sample = ranked(title.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE_SHARE)) == 0), open_, cores)
    floors = sample.where(F.col("rank") == limit).select("query_id", F.col("title_match").alias("reached"))
    floored = materialise(
        open_.join(floors, "query_id", "left").withColumn("floor", F.coalesce("reached", "floor")).drop("reached"), "floors"
    )
    found = ranked(title, floored, cores * TASKS_PER_CORE)
    return found.select("query_id", "rank", "id", "title_match")


def hybrid_score(
    semantic: Column, keyword: Column, title_vector: Column, title_text: Column,
    semantic_weight: float, title_weight: float,
) -> Column:
    """Weighted sum, in a fixed order of operations. Its maximum is
    1 + ``title_weight`` and it may be negative; it is not clamped."""
    semantic_part = semantic * F.lit(float(semantic_weight))
    keyword_part = keyword * F.lit(1.0 - semantic_weight)
    title_part = (title_vector + title_text) / 2 * F.lit(float(title_weight))
    return semantic_part + keyword_part + title_part


def add_keyword(pairs: DataFrame, keyword: DataFrame) -> DataFrame:
    """Adds ``keyword_relevance`` from ``keyword(query_id, id, keyword)``, which has no other pairs; 0 if absent."""
    relevance = F.coalesce("keyword", F.lit(0.0))
    return pairs.join(keyword, ["query_id", "id"], "left").withColumn("keyword_relevance", relevance).drop("keyword")


def add_query(pairs: DataFrame, queries: DataFrame, n_queries: int | None = None) -> DataFrame:
    """Adds the text ``query``; few queries come to the pairs, which stay spread out."""
    return pairs.join(broadcast_if_few(queries.select("query_id", "query"), n_queries), "query_id")


def _score_with(title_text: Column, semantic_weight: float, title_weight: float) -> Column:
    return hybrid_score(
        F.col("semantic_similarity"), F.col("keyword_relevance"), F.col("title_relevance"), title_text,
        semantic_weight, title_weight,
    )


def drop_outranked(
    pairs: DataFrame, limit: int, semantic_weight: float, title_weight: float,
    margin: float, n_queries: int | None = None,
) -> DataFrame:
    """Without pairs that ``limit`` others of their query are sure to beat.

    Only the title's text match is still unknown. It is at most the ratio of the
    two lengths, so most pairs are settled without an edit distance.
    """
    lengths = [F.char_length(F.lower(F.col(c))) for c in ("query", "title")]
    ratio = F.coalesce(F.least(*lengths) / F.nullif(F.greatest(*lengths), F.lit(0)), F.lit(0.0))
    ends = [_score_with(end, semantic_weight, title_weight) for end in (F.lit(0.0), ratio)]
    bounded = pairs.withColumns({"at_least": F.least(*ends), "at_most": F.greatest(*ends)})
    floors = (
        best_per_query(bounded.select("query_id", "id", "at_least"), "at_least", limit)
        .where(F.col("rank") == limit)
        .select("query_id", F.col("at_least").alias("floor"))
    )
    return (
        bounded.join(broadcast_if_few(floors, n_queries), "query_id", "left")
        .where(F.col("floor").isNull() | (F.col("at_most") >= F.col("floor") - margin))
        .drop("at_least", "at_most", "floor")
    )


def score_pairs(
    pairs: DataFrame, semantic_weight: float, title_weight: float, decimals: int | None = None
) -> DataFrame:
    """Adds ``score`` to pairs with ``query, title`` and the three relevances."""
    matched = pairs.withColumn("title_match", title_match(F.col("query"), F.col("title")))
    return add_score(matched, semantic_weight, title_weight, decimals)


def add_score(
    pairs: DataFrame, semantic_weight: float, title_weight: float, decimals: int | None = None
) -> DataFrame:
    """Adds ``score`` to pairs with all of its parts."""
    score = _score_with(F.col("title_match"), semantic_weight, title_weight)
    return pairs.withColumn("score", score if decimals is None else F.round(score, decimals))


def top_results(scored: DataFrame, threshold: float | None, limit: int | None) -> DataFrame:
    """Scores at or above the threshold, then the best ``limit`` of each query.

    Without a limit results are not ranked: a rank over everything a query
    matches would put all of it into one task.
    """
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    passed = scored if threshold is None else scored.where(F.col("score") >= F.lit(float(threshold)))
    if limit is None:
        return passed.withColumn("rank", F.lit(None).cast("int"))
    return best_per_query(passed, "score", limit)


def result_view(results: DataFrame) -> DataFrame:
    """``query_id, rank, title, score, relevance, snippet`` as display text."""
    content = F.col("content")
    snippet = F.when(
        F.char_length(content) > SNIPPET, F.concat(F.substring(content, 1, SNIPPET), F.lit("..."))
    ).otherwise(content)
    return results.select(
        "query_id",
        "rank",
        F.when(F.col("title") == "", "Untitled").otherwise(F.col("title")).alias("title"),
        to_fixed(F.col("score"), 4).alias("score"),
        F.concat(to_fixed(F.col("relevance") * 100, 2), F.lit("%")).alias("relevance"),
        snippet.alias("snippet"),
    )
