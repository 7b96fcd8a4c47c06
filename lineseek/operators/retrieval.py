"""Pruned keyword retrieval: each query's best documents, without a row per query and document.

Postings of the asked terms are gathered into blocks of documents, queries into blocks of
queries, and each block of one meets each block of the other. A task adds up the
scores of a pair of blocks as one matrix and returns what may be among the ``k`` best.
The largest posting of each term in a block bounds what a query can reach there; a query
whose bound is below the ``k``-th score it has already seen skips the block.
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

from lineseek.operators.vectors import best_per_query
from lineseek.session import BROADCAST_ROWS, materialise

# Tasks get the functions below themselves, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DOCS_PER_BLOCK, QUERIES_PER_BLOCK = 1024, 1024
CELLS = 2_000_000  # document x query cells, and postings, added up at a time


def posting_blocks(matched: DataFrame, n_docs: Column) -> DataFrame:
    """``block, postings`` from ``term, doc_id, weight``: a row per block of documents."""
    blocks = F.greatest(F.lit(1), (n_docs / DOCS_PER_BLOCK).cast("bigint"))
    placed = matched.withColumn("block", F.pmod(F.xxhash64("doc_id"), blocks))
    entry = F.struct("term", F.col("doc_id").alias("id"), "weight")
    return placed.groupBy("block").agg(F.collect_list(entry).alias("postings"))


def query_blocks(terms: DataFrame, n_queries: int) -> DataFrame:
    """``query_block, queries`` from ``query_id, term``: a row per block of queries."""
    place = F.pmod(F.xxhash64("query_id"), F.lit(n_queries // QUERIES_PER_BLOCK + 1))
    lists = terms.where(F.col("term") != "").groupBy("query_id").agg(F.collect_set("term").alias("terms"))
    return lists.groupBy(place.alias("query_block")).agg(
        F.collect_list(F.struct("query_id", "terms")).alias("queries")
    )


class _Postings:
    """Postings of one block of documents, by term."""

    def __init__(self, rows: pa.StructArray):
        terms, documents = rows.field("term").dictionary_encode(), rows.field("id").dictionary_encode()
        term = terms.indices.to_numpy()
        order = np.argsort(term, kind="stable")
        self.terms, self.ids = terms.dictionary, documents.dictionary
        self.document = documents.indices.to_numpy()[order]
        self.weight = rows.field("weight").to_numpy(zero_copy_only=False)[order]
        self.counts = np.bincount(term, minlength=len(self.terms))
        self.starts = np.cumsum(self.counts) - self.counts
        self.tops = np.maximum.reduceat(self.weight, self.starts)

    def scores(self, query: np.ndarray, term: np.ndarray, n_queries: int) -> np.ndarray:
        """Query x document sums for pairs of a query and a term."""
        lengths = self.counts[term]
        upto = np.cumsum(lengths) - lengths
        source = np.repeat(self.starts[term] - upto, lengths) + np.arange(int(lengths.sum()))
        cell = np.repeat(query, lengths) * len(self.ids) + self.document[source]
        return np.bincount(cell, self.weight[source], n_queries * len(self.ids)).reshape(n_queries, len(self.ids))


class _Best:
    """What a task knows of one block of queries: their ``k`` best scores and who has them."""

    def __init__(self, queries: pa.StructArray, k: int):
        self.ids = queries.field("query_id")
        lists = queries.field("terms")
        self.terms = lists.flatten()
        self.owner = np.repeat(np.arange(len(self.ids)), pc.list_value_length(lists).to_numpy())
        self.top = np.zeros((len(self.ids), k))
        self.held: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
        self.n_held = 0

    def add(self, postings: _Postings, margin: float) -> None:
        found = pc.fill_null(pc.index_in(self.terms, value_set=postings.terms), -1).to_numpy(zero_copy_only=False)
        known = found >= 0
        owner, term = self.owner[known], found[known]
        bound = np.bincount(owner, postings.tops[term], len(self.ids))
        open_ = np.flatnonzero((bound > 0) & (bound >= self.top[:, 0] - margin))
        if not len(open_):
            return
        place = np.full(len(self.ids), -1)
        place[open_] = np.arange(len(open_))
        mine = place[owner] >= 0
        owner, term = place[owner[mine]], term[mine]
        most = int(np.bincount(owner, postings.counts[term]).max())
        step = max(1, CELLS // max(len(postings.ids), most))
        for first in range(0, len(open_), step):
            rows = open_[first : first + step]
            part = slice(*np.searchsorted(owner, [first, first + len(rows)]))
            scores = postings.scores(owner[part] - first, term[part], len(rows))
            self._keep(rows, scores, postings.ids, margin)

    def _keep(self, rows: np.ndarray, scores: np.ndarray, ids: pa.Array, margin: float) -> None:
        k = self.top.shape[1]
        merged = np.concatenate([self.top[rows], scores], axis=1)
        self.top[rows] = np.sort(np.partition(merged, merged.shape[1] - k, axis=1)[:, -k:], axis=1)
        query, document = np.nonzero((scores > 0) & (scores >= self.top[rows, :1] - margin))
        self.held.append((rows[query], ids.take(pa.array(document)), scores[query, document]))
        self.n_held += len(query)
        if self.n_held > 4 * self.top.size + CELLS:
            self.held = [self._left(margin)]
            self.n_held = len(self.held[0][0])

    def _left(self, margin: float) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        query = np.concatenate([part[0] for part in self.held])
        score = np.concatenate([part[2] for part in self.held])
        good = np.flatnonzero(score >= self.top[query, 0] - margin)
        return query[good], pa.concat_arrays([part[1] for part in self.held]).take(pa.array(good)), score[good]

    def rows(self, margin: float) -> pa.RecordBatch | None:
        if not self.held:
            return None
        query, ids, score = self._left(margin)
        return pa.RecordBatch.from_arrays([self.ids.take(pa.array(query)), ids, pa.array(score)], ["query_id", "id", "score"])


def best_documents(
    matched: DataFrame, terms: DataFrame, k: int, n_docs: Column, n_queries: int, margin: float = 1e-9,
    n_terms: int | None = None,
) -> DataFrame:
    """``query_id, id, score`` of documents that may be among the ``k`` best of their query.

    ``matched`` has ``term, doc_id, weight`` (positive), once for each term and document,
    ``terms`` has ``query_id, term``. Every document above the ``k``-th score is there, and those
    within ``margin`` of it; a task returns no more than ``k`` rows a query but for such ties.
    Queries without a known term have no rows. ``n_terms`` counts the rows of ``terms``, if
    known: few are sent to all tasks; otherwise Spark decides by the size of the stored table, and
    pairs partitions of both if it is large.
    """
    document_type = matched.schema["doc_id"].dataType.simpleString()
    query_type = terms.schema["query_id"].dataType.simpleString()
    asked = query_blocks(terms, n_queries)
    few = n_terms is not None and n_terms <= BROADCAST_ROWS
    asked = F.broadcast(asked) if few else materialise(asked, "query-blocks")

    def retrieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, _Best] = {}
        last: tuple[int | None, _Postings | None] = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                number, name = batch.column("block")[i].as_py(), batch.column("query_block")[i].as_py()
                if last[0] != number:
                    last = number, _Postings(batch.column("postings")[i].values)
                if name not in best:
                    best[name] = _Best(batch.column("queries")[i].values, k)
                best[name].add(last[1], margin)
        for held in best.values():
            found = held.rows(margin)
            if found is not None:
                yield found

    pairs = posting_blocks(matched, n_docs).crossJoin(asked)
    return pairs.mapInArrow(retrieve, f"query_id {query_type}, id {document_type}, score double")


def keyword_hits(
    matched: DataFrame, terms: DataFrame, k: int, n_docs: Column, n_queries: int, n_terms: int | None = None
) -> DataFrame:
    """``query_id, id, score, rank``: the ``k`` best documents of each query, ties by id."""
    return best_per_query(best_documents(matched, terms, k, n_docs, n_queries, n_terms=n_terms), "score", k)
