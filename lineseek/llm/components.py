"""Connected components of a table of edges, by alternating large-star and small-star steps.

Before each step the edges are contracted in tasks of bounded size: what a task's
own edges connect becomes a star around its least node. The fewer the tasks, the
fewer the steps; where one task holds all edges, none is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineseek.llm.work import materialise, tidy

EDGES_PER_TASK = 500_000


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars (a: node, b: least node) that connect what the edges of a task connect."""
    held = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
    if not sum(len(a) for a, _ in held):
        return
    ends = np.concatenate([np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held])])
    nodes, places = np.unique(ends, return_inverse=True)
    a, b = np.split(places, 2)
    least = np.arange(len(nodes))
    while True:
        one, other = least[a], least[b]
        if (one == other).all():
            break
        np.minimum.at(least, np.maximum(one, other), np.minimum(one, other))
        while (least[least] != least).any():
            least = least[least]
    child = np.flatnonzero(least != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[child]), pa.array(nodes[least[child]])], ["a", "b"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node sends its larger neighbours to the least node it knows."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
    joined = both.join(least, F.col("a") == F.col("node")).where("b > a")
    return joined.select(F.col("b").alias("a"), F.least("least", "node").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node sends itself and its smaller neighbours to the least of them."""
    least = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
    smaller = edges.join(least, F.col("a") == F.col("node")).where("b <> least")
    return smaller.select(F.col("b").alias("a"), F.col("least").alias("b")).union(
        least.select(F.col("node").alias("a"), F.col("least").alias("b"))
    )


def _is_settled(edges: DataFrame) -> bool:
    """Has every node one root at most, and no root a smaller one?"""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).union(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent"))
    )
    both = ends.groupBy("node").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
    return both.where("child > 1 OR (child = 1 AND parent = 1)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (a, b; whole numbers): the least
    node it is connected with.

    A node's neighbours are never gathered: minima are combined before the
    shuffle, and the joins are plain ones that adaptive execution can split.
    Each round is written to the shared folder. Loops and repeated edges are
    allowed; no edges give no rows.
    """
    larger, smaller = F.greatest("a", "b"), F.least("a", "b")
    edges = edges.where("a <> b").select(larger.cast("long").alias("a"), smaller.cast("long").alias("b")).distinct()
    edges = materialise(edges, "edges")
    settled = False
    while not settled:
        tasks = -(-edges.count() // EDGES_PER_TASK)
        stars = edges.coalesce(max(1, tasks)).mapInArrow(tidy(contracted), "a bigint, b bigint")
        if tasks > 1:
            stars = _small_star(_large_star(stars)).distinct()
        edges = materialise(stars, "edges")
        settled = tasks <= 1 or _is_settled(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
