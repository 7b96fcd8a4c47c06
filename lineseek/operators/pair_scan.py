"""One pass over stored vectors that finds the pairs able to reach a result list.

Every query is compared with every document, but pairs are never rows: documents
are packed where they lie into rows of a few thousand, queries into rows of
their own, and each row of one meets each of the other. A task multiplies the
two matrices and lets go of each pair that provably cannot be returned. What is left,
a few rows per query and task, goes on to exact scoring in Spark. Neither side
passes through the driver, and the documents are scanned once for any number of
queries: Spark sends the packed queries to all tasks if they are small, and else
pairs partitions of both.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineseek.operators.edit_distance import Titles, code_points
from lineseek.session import materialise

# Tasks get the functions below themselves, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUERIES_PER_SCAN = 1024  # queries packed into one row
DOCS_PER_ROW = 2048
FEW_QUERIES = 10_000  # so many are sent to all tasks; more only if their stored table is small enough for Spark
SAMPLE_FROM, SAMPLE_SHARE = 1000, 64  # from so many queries on, one document of 64 gives them all a first floor
CELLS = 1_000_000  # document x query cells computed at a time


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column cut or zero-padded to ``width``, and their lengths."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    longest = int(lengths.max(initial=0))
    if len(lengths) and (lengths == longest).all():
        rows = flat.reshape(len(lengths), longest)
    else:
        rows = np.zeros((len(lengths), longest))
        rows[np.arange(longest) < lengths[:, None]] = flat
    if longest < width:
        rows = np.pad(rows, ((0, 0), (0, width - longest)))
    return rows[:, :width], np.minimum(lengths, width)


def vector_cosines(column: pa.Array, queries: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Query x document cosines on vectors cut to the shorter length of each pair.

    ``squares`` holds the queries' running sums of squares, so the norm of a query
    cut to any document's length is a lookup.
    """
    rows, lengths = _matrix(column, queries.shape[1])
    if (lengths == queries.shape[1]).all():
        query_squares = squares[:, -1:]
    else:
        query_squares = squares[:, lengths]
    norms = np.sqrt(query_squares) * np.sqrt((rows * rows).sum(axis=1))
    dots = queries @ rows.T
    return np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)


class _QueryBlock:
    """Queries of one vector length, as arrays."""

    def __init__(self, rows: pa.Table, hits: pa.Table):
        self.ids = rows.column("query_id").combine_chunks()
        vectors = rows.column("query_vec").combine_chunks()
        width = len(vectors[0])
        self.vectors = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(self.ids), width)
        self.squares = np.pad(np.cumsum(self.vectors**2, axis=1), ((0, 0), (1, 0)))
        self.texts = [code_points(text).tolist() for text in rows.column("text").to_pylist()]
        self.alphabet = np.unique(np.array([point for text in self.texts for point in text], np.uint32))
        self.text_lengths, self.weak_keyword, self.floor = (
            rows.column(name).to_numpy().astype(np.float64)[:, None] for name in ("text_length", "weak_keyword", "floor")
        )
        place = pc.index_in(hits.column("query_id"), value_set=self.ids)
        mine = hits.filter(pc.is_valid(place))
        self.hit_query = pc.drop_null(place).to_numpy()
        self.hit_id, self.hit_keyword = mine.column("id").combine_chunks(), mine.column("keyword").to_numpy()

    def keyword(self, documents: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the keyword relevance of each query and document: the known
        value of a strong hit, else from 0 to the query's weak limit."""
        low = np.zeros((len(self.ids), len(documents)))
        high = np.repeat(self.weak_keyword, len(documents), axis=1)
        if len(self.hit_id):
            place = pc.fill_null(pc.index_in(self.hit_id, value_set=documents), -1).to_numpy(zero_copy_only=False)
            mine = np.flatnonzero(place >= 0)
            low[self.hit_query[mine], place[mine]] = high[self.hit_query[mine], place[mine]] = self.hit_keyword[mine]
        return low, high


def _written(rows: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as stream:
        stream.write(rows)
    return sink.getvalue().to_pybytes()


def read_rows(packed: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(packed.as_buffer()).read_all()


def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, DOCS_PER_ROW):
            row = pa.array([_written(batch.slice(start, DOCS_PER_ROW))], pa.binary())
            yield pa.RecordBatch.from_arrays([row], ["documents"])


def _pack_queries(group: pa.Table) -> pa.Table:
    number = group.column("query_block")[0].as_py()
    return pa.table({"query_block": pa.array([number], pa.int64()), "queries": pa.array([_written(group)], pa.binary())})


def _query_blocks(packed: pa.Scalar) -> list[_QueryBlock]:
    """The queries of a packed row, by length of their vectors."""
    rows = read_rows(packed)
    lists = rows.column("hits").combine_chunks()
    owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).fill_null(0).to_numpy())
    listed = lists.flatten()
    hits = pa.table({
        "query_id": rows.column("query_id").combine_chunks().take(pa.array(owner)),
        "id": listed.field("id"), "keyword": listed.field("keyword"),
    })
    widths = pc.list_value_length(rows.column("query_vec")).to_numpy()
    return [_QueryBlock(rows.filter(pa.array(widths == width)), hits) for width in np.unique(widths)]


def _first_of_equal(ids: pa.Array, rows: np.ndarray, limit: int, *parts: np.ndarray) -> np.ndarray:
    """Which of ``rows`` are among the ``limit`` least ids of those with the same parts of a score."""
    by_id = rows[pc.array_sort_indices(ids.take(pa.array(rows)), null_placement="at_start").to_numpy()]
    values = np.stack([part[by_id] for part in parts])
    order = np.lexsort(values)  # stable: ids stay in order
    values = values[:, order]
    new = np.append(True, (values[:, 1:] != values[:, :-1]).any(axis=0))
    place = np.arange(len(rows)) - np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
    return np.isin(rows, by_id[order[place < limit]])


class _TopBounds:
    """Per query, the k-th best score that documents seen so far are sure to reach,
    and no less than the floor it came with."""

    def __init__(self, given: np.ndarray, k: int | None):
        self.given = given
        self.best = None if k is None else np.full((len(given), k), -np.inf)

    def floor(self, sure: np.ndarray, keep: bool = True) -> np.ndarray:
        """With the scores of more documents; those that come again with better ones aren't to be kept yet."""
        if self.best is None:
            return self.given
        k = self.best.shape[1]
        merged = np.concatenate([self.best, sure], axis=1)
        best = np.partition(merged, merged.shape[1] - k, axis=1)[:, -k:]
        if keep:
            self.best = best
        return np.maximum(best[:, :1], self.given)


def candidate_pairs(
    signals: DataFrame,
    queries: DataFrame,
    *,
    semantic_weight: float,
    title_weight: float,
    keyword_weight: float = 0.0,
    hits: DataFrame | None = None,
    n_queries: int | None = None,
    threshold: float | None,
    limit: int | None,
    margin: float = 1e-9,
    repeated_ids: bool = False,
) -> DataFrame:
    """``query_id, id, title, semantic_similarity, title_relevance, at_least`` of pairs that
    may score at least ``threshold`` and be among the ``limit`` best of a query.

    ``signals`` has ``id, title, content_vec, title_vec``; ``queries`` has
    ``query_id, query, query_vec``; ``hits`` has ``query_id, id, keyword, weak``: the
    keyword relevance, in [0, 1], of a bounded number of each query's best documents, and
    what any other document of the query can have at most.

    A score is the weighted sum of vector, keyword and title parts. Here the
    vector parts are exact, keyword parts lie between bounds, and the title's text
    similarity is at most the ratio of the two lengths; only pairs that this doesn't rule
    out get an edit distance, and then their title part is exact. A pair is dropped only if
    its upper bound is below the threshold, or below the lower bounds of
    ``limit`` other documents of the query: those the task has seen, or, with
    many queries, those of a sample that is scanned first. ``margin`` keeps
    pairs whose difference is a matter of rounding. ``repeated_ids`` tells that several queries or
    documents may have one id: such pairs are scored together later on, by more than they have
    here, so they are held against the looser bounds alone.
    """
    half_title = title_weight / 2
    limit = limit if limit is None else max(limit, 1)
    n_queries = queries.count() if n_queries is None else n_queries
    few = n_queries <= FEW_QUERIES
    exact_titles = bool(half_title) and not repeated_ids and not (limit is None and threshold is None)
    id_type = signals.schema["id"].dataType.simpleString()
    query_type = queries.schema["query_id"].dataType.simpleString()
    schema = (
        f"query_id {query_type}, id {id_type}, title string, "
        "semantic_similarity double, title_relevance double, at_least double"
    )
    scanned = signals.select(
        "id", "title", "content_vec", "title_vec", F.char_length(F.lower("title")).alias("title_length"),
        F.lower("title").alias("lower_title"),
    )
    asked = queries.select(
        "query_id",
        F.coalesce("query_vec", F.array().cast("array<float>")).cast("array<float>").alias("query_vec"),
        F.lower(F.coalesce("query", F.lit(""))).alias("text"),
    ).withColumn("text_length", F.char_length("text"))
    if hits is None:
        lists = F.array().cast(f"array<struct<id:{id_type},keyword:double>>")
        asked = asked.withColumns({"hits": lists, "weak_keyword": F.lit(0.0)})
    else:
        by_query = hits.groupBy("query_id").agg(
            F.collect_list(F.struct("id", "keyword")).alias("hits"), F.max("weak").alias("weak")
        )
        asked = asked.join(by_query, "query_id", "left").withColumn("weak_keyword", F.coalesce("weak", F.lit(0.0))).drop("weak")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: dict[int, list[_TopBounds]] = {}
        known: dict[int, list[_QueryBlock]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                number = batch.column("query_block")[i].as_py()
                if batch.column("queries")[i].is_valid:
                    known = known if few else {}
                    known[number] = _query_blocks(batch.column("queries")[i])
                blocks = known[number]
                if number not in tops:
                    tops[number] = [_TopBounds(block.floor, limit) for block in blocks]
                documents = read_rows(batch.column("documents")[i]).combine_chunks().to_batches()
                step = max(1, CELLS // max(1, sum(len(block.ids) for block in blocks)))
                for part in documents:
                    for start in range(0, part.num_rows, step):
                        for block, top in zip(blocks, tops[number], strict=True):
                            yield from survivors(part.slice(start, step), block, top)

    def survivors(part: pa.RecordBatch, block: _QueryBlock, top: _TopBounds) -> Iterator[pa.RecordBatch]:
        content = vector_cosines(part.column("content_vec"), block.vectors, block.squares)
        title = np.zeros_like(content)
        at_most = semantic_weight * content
        if keyword_weight:
            low, high = block.keyword(part.column("id"))
            bounds = keyword_weight * low, keyword_weight * high
            at_least = at_most + np.minimum(*bounds)
            at_most = at_most + np.maximum(*bounds)
        else:
            at_least = at_most
        if half_title:
            title = vector_cosines(part.column("title_vec"), block.vectors, block.squares)
            lengths = pc.fill_null(part.column("title_length"), 0).to_numpy(zero_copy_only=False)
            longer = np.maximum(block.text_lengths, lengths)
            shorter = np.minimum(block.text_lengths, lengths)
            ratio = np.divide(shorter, longer, out=np.zeros_like(longer), where=longer > 0)
            sure, possible = at_least + half_title * title, at_most + half_title * title
            at_least = sure + np.minimum(half_title * ratio, 0.0)
            at_most = possible + np.maximum(half_title * ratio, 0.0)
        keep = at_most >= top.floor(at_least, not exact_titles) - margin
        if threshold is not None:
            keep &= at_most >= threshold - margin
        if exact_titles:
            titles = Titles(part.column("lower_title"), block.alphabet)
            for q in np.flatnonzero(keep.any(axis=1)):
                rows = np.flatnonzero(keep[q])
                match = half_title * titles.matches(block.texts[q], rows)
                at_least[q, rows], at_most[q, rows] = sure[q, rows] + match, possible[q, rows] + match
            keep &= at_most >= top.floor(at_least) - margin
            if threshold is not None:
                keep &= at_most >= threshold - margin
        if limit is not None and not repeated_ids:
            settled = at_least == at_most
            for q in np.flatnonzero((keep & settled).sum(axis=1) > limit):
                rows = np.flatnonzero(keep[q] & settled[q])
                keep[q, rows[~_first_of_equal(part.column("id"), rows, limit, content[q], title[q], at_most[q])]] = False
        query_at, doc_at = np.nonzero(keep)
        if len(doc_at) == 0:
            return
        take = pa.array(doc_at)
        yield pa.RecordBatch.from_arrays(
            [
                block.ids.take(pa.array(query_at)),
                part.column("id").take(take),
                part.column("title").take(take),
                pa.array(content[query_at, doc_at]),
                pa.array(title[query_at, doc_at]),
                pa.array(at_least[query_at, doc_at]),
            ],
            names=["query_id", "id", "title", "semantic_similarity", "title_relevance", "at_least"],
        )

    def pairs(documents: DataFrame, asked: DataFrame) -> DataFrame:
        packed = documents.mapInArrow(pack_rows, "documents binary")
        place = F.pmod(F.xxhash64("query_id"), F.lit(n_queries // QUERIES_PER_SCAN + 1))
        blocks = asked.withColumn("query_block", place).groupBy("query_block").applyInArrow(
            _pack_queries, "query_block bigint, queries binary"
        )
        if not few:
            return packed.crossJoin(materialise(blocks, "query-blocks")).mapInArrow(scan, schema)
        # A task's first row of documents meets all blocks before its second does: beyond
        # those pairs a block goes by its number, so that a batch holds its bytes once.
        place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        once = F.when(place <= n_queries // QUERIES_PER_SCAN, F.col("queries")).alias("queries")
        return packed.crossJoin(F.broadcast(blocks)).select("documents", "query_block", once).mapInArrow(scan, schema)

    asked = asked.withColumn("floor", F.lit(float("-inf")))
    if limit is not None and n_queries >= SAMPLE_FROM:
        sample = scanned.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE_SHARE)) == 0)
        asked = materialise(asked, "asked")
        order = Window.partitionBy("query_id").orderBy(F.col("at_least").desc())
        reached = pairs(sample, asked).withColumn("place", F.row_number().over(order)).where(F.col("place") == limit)
        floors = reached.select("query_id", F.col("at_least").alias("reached"))
        asked = asked.join(floors, "query_id", "left").withColumn("floor", F.coalesce("reached", "floor")).drop("reached")
    return pairs(scanned, asked)
