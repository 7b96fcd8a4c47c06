"""Exact top-k search by inner product with Fagin's threshold algorithm.

Vectors lie in blocks of bounded size. A block keeps one sorted list per
dimension. For a query the lists are read from their better ends, a growing
depth at a time; every vector seen is scored in full. What is unseen can't
score more than the query's inner product with the values at the current depth
of all lists; reading stops when that bound is below the k-th score so far.

Queries lie in blocks as well. Each pair of a vector block and a query block is
one unit of work, whose result is at most k rows per query; those are merged by
a window that cuts to k before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineseek.llm.work import materialise, shuffle_partitions

SCALE = 256.0
BLOCK_BYTES = 2 << 20
QUERIES_PER_BLOCK = 256
FIRST_DEPTH = 64
LONGS = np.iinfo(np.int64)

BLOCK_SCHEMA = "dim int, block bigint, ids binary, vectors binary"


def usable(vector: Column) -> Column:
    """Not null, and nothing in it null, NaN or infinite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def whole_numbers(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))


def blocks(vectors: DataFrame, rows_per_block: int | None = None) -> DataFrame:
    """``vectors`` (vec_id, vec) packed in blocks of one dimension each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, part_no = 0, TaskContext.get().partitionId()
        for batch in batches:
            lists = batch.column(1)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            bounds = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False)
            dims = np.diff(bounds)
            for dim in np.unique(dims):
                mine = np.flatnonzero(dims == dim)
                matrix = values[bounds[mine][:, None] + np.arange(dim)[None, :]]
                size = rows_per_block or max(1, BLOCK_BYTES // (8 * max(1, int(dim))))
                for start in range(0, len(mine), size):
                    part = slice(start, start + size)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([int(dim)], pa.int32()), pa.array([(part_no << 32) + made], pa.int64()),
                            pa.array([ids[mine[part]].tobytes()], pa.binary()),
                            pa.array([matrix[part].tobytes()], pa.binary()),
                        ],
                        ["dim", "block", "ids", "vectors"],
                    )
                    made += 1

    return vectors.mapInArrow(pack, BLOCK_SCHEMA)


def _as_long(scores: np.ndarray) -> np.ndarray:
    if scores.dtype == object:
        scores = np.clip(scores, LONGS.min, LONGS.max)
    return scores.astype(np.int64)


class SortedLists:
    """A block with its rows in the order of each dimension, and the values in that order."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        self.ids, self.matrix = ids, matrix
        self.order = np.ascontiguousarray(np.argsort(matrix, axis=0, kind="stable").T)
        self.sorted = np.ascontiguousarray(np.sort(matrix, axis=0).T)

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows other than ``query_id``'s, ties to smaller ids."""
        n = len(self.ids)
        rising, falling = self.order[query < 0], self.order[query > 0]  # better end: small values, large values
        unseen = self.ids != query_id
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, upto = 0, FIRST_DEPTH
        while unseen.any():
            upto = min(n, upto)
            if len(rising) or len(falling):
                met = np.zeros(n, bool)
                met[rising[:, depth:upto]] = True
                met[falling[:, n - upto : n - depth]] = True
                fresh = np.flatnonzero(met & unseen)
            else:
                fresh = np.flatnonzero(unseen)
            unseen[fresh] = False
            scored = _as_long(self.matrix[fresh] @ query)
            if len(scores) == k:
                good = scored >= scores[-1]
                fresh, scored = fresh[good], scored[good]
            ids, scores = np.concatenate([ids, self.ids[fresh]]), np.concatenate([scores, scored])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            if upto == n:
                break
            edge = np.where(query < 0, self.sorted[:, upto - 1], self.sorted[:, n - upto])
            if len(scores) == k and edge @ query < scores[-1] < LONGS.max:
                break
            depth, upto = upto, 3 * upto
        return ids, scores


def _matrix(raw: bytes, rows: int, dim: int, exact: bool) -> np.ndarray:
    """Whole numbers as floats where every product stays exact, else as Python integers."""
    return np.frombuffer(raw, np.int64).reshape(rows, dim).astype(float if exact else object)


def _largest(raw: bytes) -> float:
    return float(np.abs(np.frombuffer(raw, np.int64).astype(float)).max(initial=0.0))


def _search(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lists = None, None
        for batch in batches:
            for row in batch.to_pylist():
                dim, exact = row["dim"], _largest(row["vectors"]) * _largest(row["queries"]) * row["dim"] < 2.0**53
                if held != (row["block"], exact):
                    held = (row["block"], exact)
                    ids = np.frombuffer(row["ids"], np.int64)
                    lists = SortedLists(ids, _matrix(row["vectors"], len(ids), dim, exact))
                asked = np.frombuffer(row["query_ids"], np.int64)
                queries = _matrix(row["queries"], len(asked), dim, exact)
                found = [lists.top(int(q), vector, k) for q, vector in zip(asked, queries, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(asked, [len(ids) for ids, _ in found])),
                        pa.array(np.concatenate([ids for ids, _ in found])),
                        pa.array(np.concatenate([scores for _, scores in found])),
                    ],
                    ["query_id", "vec_id", "score"],
                )

    return search


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``queries`` the ``k`` rows
    of ``vectors`` with other ids and the highest integer inner products.

    Components x count as floor(256 x). Ties go to smaller ids; a query with
    fewer candidates gets all. Vectors that are null, or hold null, NaN or
    infinity, and rows without an id take no part; vectors are compared with
    those of their own length. Rows repeated exactly count once, on either side;
    an id with several vectors is several candidates, never its own query's.
    Scores beyond 64 bits are held at that limit, and so tie.
    Other columns don't matter. Empty tables give no rows.
    """

    def clean(rows: DataFrame) -> DataFrame:
        rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vec"))
        rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vec")))
        return rows.select("vec_id", whole_numbers(F.col("vec")).alias("vec"))

    spark = vectors.sparkSession
    held = materialise(blocks(clean(vectors).distinct()), "blocks")
    asked = blocks(clean(queries).distinct(), QUERIES_PER_BLOCK)
    # vector blocks are dealt to groups, no more than these can fill; each query block goes to every group
    groups = 2 * min(shuffle_partitions(spark), max(1, held.count()))
    held = held.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(groups)))
    asked = asked.select(
        F.col("dim").alias("query_dim"),
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("query_part"),
        F.col("ids").alias("query_ids"),
        F.col("vectors").alias("queries"),
    )
    # Spark's estimate of the copies leaves out how many there are: it would broadcast them through the driver
    asked = asked.hint("merge")
    paired = held.join(asked, (F.col("part") == F.col("query_part")) & (F.col("dim") == F.col("query_dim")))
    found = paired.select("dim", "block", "ids", "vectors", "query_ids", "queries").mapInArrow(
        _search(k), "query_id bigint, vec_id bigint, score bigint"
    )
    order = [F.col("score").desc(), F.col("vec_id")]
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return found.select("query_id", place.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
