"""Every query against every document: all parts of all scores, without a shuffle of pairs.

Documents, with their vectors and titles, and the postings of the asked terms are dealt
to blocks by id. A block meets the queries and a task works out its part of the
table of scores as matrices. Pairs are rows only on their way out.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineseek.operators.edit_distance import Titles, code_points
from lineseek.operators.pair_scan import FEW_QUERIES, QUERIES_PER_SCAN, vector_cosines
from lineseek.operators.retrieval import DOCS_PER_BLOCK, _Postings
from lineseek.session import materialise

# Tasks get the functions below themselves, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUERIES_OUT = 64  # queries whose pairs leave at a time
TASKS_PER_CORE = 8


def _semantic(vectors: pa.Array, documents: pa.Array) -> np.ndarray:
    """Query x document cosines; queries are taken by the length of their vectors."""
    widths = pc.list_value_length(vectors).to_numpy()
    found = np.zeros((len(vectors), len(documents)))
    for width in np.unique(widths):
        mine = np.flatnonzero(widths == width)
        rows = vectors.take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        rows = rows.reshape(len(mine), width)
        squares = np.pad(np.cumsum(rows**2, axis=1), ((0, 0), (1, 0)))
        found[mine] = vector_cosines(documents, rows, squares)
    return found


def _keyword(queries: pa.RecordBatch, ids: pa.Array, listed: pa.Scalar) -> np.ndarray:
    """Query x document relevances: the sum of the shared terms' weights over the query's best."""
    found = np.zeros((len(queries), len(ids)))
    if not listed.is_valid:
        return found
    postings, lists = _Postings(listed.values), queries.column("terms")
    owner = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    term = pc.fill_null(pc.index_in(lists.flatten(), value_set=postings.terms), -1).to_numpy()
    scores = postings.scores(owner[term >= 0], term[term >= 0], len(lists))
    place = pc.fill_null(pc.index_in(ids, value_set=postings.ids), -1).to_numpy()
    known = np.flatnonzero(place >= 0)
    # A score counts once for each row of its query and of its document.
    copies = np.bincount(place[known], minlength=len(postings.ids))[place[known]]
    share = queries.column("copies").to_numpy() / pc.fill_null(queries.column("best"), np.inf).to_numpy()
    found[:, known] = scores[:, place[known]] * copies * share[:, None]
    return found


def every_pair(
    signals: DataFrame, queries: DataFrame, terms: DataFrame, matched: DataFrame, n_docs: Column, n_queries: int
) -> DataFrame:
    """``query_id, id, title, semantic_similarity, keyword_relevance, title_relevance, title_match`` of all pairs.

    ``queries`` has ``query_id, query, query_vec, copies, best``: how many rows have the id, and the keyword
    score that counts as 1 (null: no document shares a term). The others are as in ``candidate_pairs``
    and ``best_documents``.
    """
    spark = signals.sparkSession
    id_type, query_type = signals.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    blocks = F.greatest(F.lit(1), (n_docs / DOCS_PER_BLOCK).cast("bigint"))

    def dealt(rows: DataFrame, key: str, entry: Column, name: str) -> DataFrame:
        placed = rows.select(F.pmod(F.xxhash64(key), blocks).alias("block"), entry.alias("entry"))
        return placed.repartition(tasks, "block").groupBy("block").agg(F.collect_list("entry").alias(name))

    document = F.struct("id", "title", F.lower("title").alias("lower_title"), "content_vec", "title_vec")
    posting = F.struct("term", F.col("doc_id").alias("id"), "weight")
    documents = dealt(signals, "id", document, "documents").join(
        dealt(matched.where(F.col("doc_id").isNotNull()), "doc_id", posting, "postings"), "block", "left"
    )
    lists = terms.where(F.col("term") != "").groupBy("query_id").agg(F.collect_set("term").alias("terms"))
    asked = queries.join(lists, "query_id", "left").select(
        "query_id", "copies", "best", "terms", F.lower(F.coalesce("query", F.lit(""))).alias("text"),
        F.coalesce("query_vec", F.array().cast("array<float>")).cast("array<float>").alias("query_vec"),
    )
    place = F.pmod(F.xxhash64("query_id"), F.lit(n_queries // QUERIES_PER_SCAN + 1)).alias("query_block")
    packed = asked.groupBy(place).agg(F.collect_list(F.struct(*asked.columns)).alias("queries"))
    packed = F.broadcast(packed) if n_queries <= FEW_QUERIES else materialise(packed, "query-blocks")

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = pa.RecordBatch.from_struct_array(batch.column("documents")[i].values)
                asked = pa.RecordBatch.from_struct_array(batch.column("queries")[i].values)
                points = [code_points(text).tolist() for text in asked.column("text").to_pylist()]
                alphabet = np.unique(np.array([point for text in points for point in text], np.uint32))
                titles = Titles(rows.column("lower_title"), alphabet)
                parts = [
                    _semantic(asked.column("query_vec"), rows.column("content_vec")),
                    _keyword(asked, rows.column("id"), batch.column("postings")[i]),
                    _semantic(asked.column("query_vec"), rows.column("title_vec")),
                ]
                for first in range(0, len(points), QUERIES_OUT):
                    some = range(first, min(first + QUERIES_OUT, len(points)))
                    owner = pa.array(np.repeat(np.array(some), len(rows)))
                    place = pa.array(np.tile(np.arange(len(rows)), len(some)))
                    match = np.concatenate([titles.matches(points[q]) for q in some])
                    yield pa.RecordBatch.from_arrays(
                        [
                            asked.column("query_id").take(owner), rows.column("id").take(place), rows.column("title").take(place),
                            *(pa.array(part[first : first + len(some)].ravel()) for part in parts), pa.array(match),
                        ],
                        names=["query_id", "id", "title", "semantic_similarity", "keyword_relevance", "title_relevance", "title_match"],
                    )

    schema = (
        f"query_id {query_type}, id {id_type}, title string, semantic_similarity double, keyword_relevance double, "
        "title_relevance double, title_match double"
    )
    return documents.crossJoin(packed).select("documents", "postings", "queries").mapInArrow(rate, schema)
