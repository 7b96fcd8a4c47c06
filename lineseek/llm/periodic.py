"""Runs of repeated words: stretches with a period, at least four times as long as it.

Periods are taken by octave. For periods from B up to 2B every B-th word is a
*boundary*: a run with such a period holds at least three of its periods of
matching words, so the 2B words after some boundary recur one period later.
Rolling hashes find the boundaries where that may be so, over all documents of
a batch at once; ordinary text has next to none.

A document is cut into overlapping tiles, 16B words or more to an octave, and
each tile with such a boundary is solved by itself: the Z-function from the boundary
gives for every period of the octave how far the match reaches to the right
and which periods are multiples of a smaller one; the match to the left
follows backwards. What a tile yields is a fragment (document, period, first and
last matching word). Fragments are dealt by document and period and stitched:
where they touch, they are one run, however many tiles it spans.

Hashes only choose the boundaries to look at; what counts is read from the words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineseek.llm.rolling import INVERSE, MULTIPLIER, mixed
from lineseek.llm.tokens import portions
from lineseek.llm.work import materialise, tidy

#: A run has at least this many words, and this many times its period.
LEAST_WORDS, LEAST_TIMES = 6, 4
TILE_WORDS, TILE_STEPS = 1024, 16  # a tile holds the larger of 1024 words and 16 boundaries
LEFT, RIGHT = 1, 5  # margins of a tile, in boundaries: fragments of neighbouring tiles overlap there

FRAGMENTS = "array<struct<period: bigint, start: bigint, end: bigint>>"
FRAGMENT_TYPE = pa.list_(pa.struct([("period", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))


class _Powers:
    """Powers of the multiplier and its inverse modulo 2 ** 64, kept for the longest batch so far."""

    ahead = np.ones(1, np.uint64)
    back = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, size: int) -> tuple[np.ndarray, np.ndarray]:
        while len(cls.ahead) < size:
            n = len(cls.ahead)
            cls.ahead = np.concatenate([cls.ahead, cls.ahead * np.uint64(pow(MULTIPLIER, n, 1 << 64))])
            cls.back = np.concatenate([cls.back, cls.back * np.uint64(pow(INVERSE, n, 1 << 64))])
        return cls.ahead, cls.back


def z_function(words: np.ndarray, upto: int) -> np.ndarray:
    """For each shift below ``upto``, how many first words recur after it."""
    n = len(words)
    z = np.zeros(min(upto, n), np.int64)
    left = right = 0
    for i in range(1, len(z)):
        known = min(right - i, int(z[i - left])) if i < right and i - left < len(z) else 0
        if known > 0 and i + known < right:
            z[i] = known
            continue
        reach = max(known, 0)
        if i + reach < n and words[reach] == words[i + reach]:
            reach += first_difference(words[reach:], words[i + reach :])
        z[i] = reach
        if i + reach > right:
            left, right = i, i + reach
    return z


def first_difference(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning, looked for in growing steps."""
    size, done, step = min(len(a), len(b)), 0, 64
    while done < size:
        different = a[done : min(done + step, size)] != b[done : min(done + step, size)]
        if different.any():
            return done + int(different.argmax())
        done += step
        step *= 4
    return size


def multiples_of_smaller(z: np.ndarray, upto: int) -> np.ndarray:
    """Marks each period below ``upto`` whose first words are a smaller period repeated."""
    marked = np.zeros(upto, bool)
    for period in range(1, len(z)):
        if z[period] >= period and not marked[period]:
            marked[2 * period : min(period + int(z[period]), upto - 1) + 1 : period] = True
    return marked


def _prefix_hashes(codes: np.ndarray) -> np.ndarray:
    ahead, _ = _Powers.upto(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mixed(codes.astype(np.uint64) + np.uint64(1)) * ahead[: len(codes)], out=sums[1:])
    return sums


def recurring_blocks(sums: np.ndarray, octave: int) -> tuple[np.ndarray, np.ndarray]:
    """``(boundary, period)`` pairs, by boundary, whose block of words seems to recur one period later."""
    n, step, block = len(sums) - 1, octave, 2 * octave
    if n < step + block:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, back = _Powers.upto(n + 1)
    windows = (sums[block:] - sums[: n + 1 - block]) * back[: n + 1 - block]
    later = windows[step:]
    same = np.flatnonzero(later == np.repeat(windows[::step], step)[: len(later)])
    boundary = same // step * step
    return boundary, same + step - boundary


def tile_fragments(
    words: np.ndarray, octave: int, boundaries: np.ndarray, periods: np.ndarray, at_start: bool, at_end: bool
) -> list[tuple[int, int, int]]:
    """``(period, first, last)`` of matching stretches in one tile: each word from ``first``
    up to (not including) ``last`` recurs one period later. Multiples of a smaller period, and
    stretches that end inside the tile without reaching the least length, are left out."""
    found = []
    done = np.zeros(octave, np.int64)  # by period: up to which word the last stretch matched
    for at in np.unique(boundaries):
        open_ = periods[boundaries == at] if len(boundaries) < 64 else periods[slice(*np.searchsorted(boundaries, [at, at + 1]))]
        open_ = open_[done[open_ - octave] <= at]
        if not len(open_):
            continue
        z = z_function(words[at:], 2 * octave)
        multiple = multiples_of_smaller(z, 2 * octave)
        for period in open_.tolist():
            reach = int(z[period]) if period < len(z) else 0
            if reach < 2 * octave:  # the hashes met, the words don't
                continue
            done[period - octave] = at + reach
            if multiple[period]:
                continue
            back = first_difference(words[:at][::-1], words[: at + period][::-1])
            first, last = int(at) - back, int(at) + reach
            cut = (first == 0 and not at_start) or (last + period == len(words) and not at_end)
            if cut or last - first + period >= max(LEAST_WORDS, LEAST_TIMES * period):
                found.append((period, first, last))
    return found


def batch_fragments(codes: np.ndarray, bounds: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """Fragments of each document of a batch: ``codes`` of all words in a row, documents from ``bounds`` to ``bounds``."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    lengths = np.diff(bounds)
    longest = int(lengths.max(initial=0))
    if longest < LEAST_WORDS:
        return out
    sums, octave = _prefix_hashes(codes), 1
    while LEAST_TIMES * octave <= longest:
        boundary, period = recurring_blocks(sums, octave)
        owner = np.searchsorted(bounds, boundary, side="right") - 1
        inside = boundary + period + 2 * octave <= bounds[owner + 1]
        boundary, period, owner = boundary[inside], period[inside], owner[inside]
        size = max(TILE_WORDS, TILE_STEPS * octave)
        tile = (boundary - bounds[owner]) // size
        edges = np.flatnonzero(np.diff(owner, prepend=-1) | np.diff(tile, prepend=-1))
        for first, last in zip(edges, np.append(edges[1:], len(owner)), strict=False):
            document, number = int(owner[first]), int(tile[first])
            start, end = int(bounds[document]), int(bounds[document + 1])
            low = max(start + number * size - LEFT * octave, start)
            high = min(start + (number + 1) * size + RIGHT * octave, end)
            for p, a, b in tile_fragments(
                codes[low:high], octave, boundary[first:last] - low, period[first:last], low == start, high == end
            ):
                out.setdefault(document, []).append((p, a + low - start, b + low - start))
        octave *= 2
    return out


def planted_order(doc_id: str, n: int) -> np.ndarray | None:
    """Which word stands at each place of a document that the query plants a period in; none if it doesn't."""
    h = zlib.crc32(doc_id.encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    order = np.arange(n)
    order[a:] = a + np.arange(n - a) % p
    return order


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words in a row, and where each text begins among them."""
    lists = pc.ascii_split_whitespace(texts)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    words = lists.flatten()
    bounds = bounds - bounds[0]
    full = pc.not_equal(pc.binary_length(words), 0)
    upto = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return words.filter(full), upto[bounds]


def _find(plant: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 33
        for batch in portions(batches, 1):
            words, bounds = _split(batch.column(1).fill_null(""))
            if plant:
                order = np.arange(len(words))
                for i, doc_id in enumerate(batch.column(2).to_pylist()):
                    moved = planted_order(doc_id, int(bounds[i + 1] - bounds[i])) if doc_id is not None else None
                    if moved is not None:
                        order[bounds[i] : bounds[i + 1]] = bounds[i] + moved
                words = words.take(pa.array(order))
            codes = words.dictionary_encode().indices.to_numpy()
            found = batch_fragments(codes, bounds)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), words), " ")
            digests = [hashlib.sha256(text.as_buffer()).hexdigest() for text in joined]
            fragments = [
                [{"period": p, "start": a, "end": b} for p, a, b in found[i]] if i in found else None
                for i in range(len(batch))
            ]
            kept = np.array([part is not None for part in fragments], bool)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(key, key + len(batch))),
                    batch.column(0),
                    pa.array(digests, pa.string()),
                    pc.if_else(pa.array(kept), joined, pa.scalar(None, pa.string())),
                    pa.array(fragments, FRAGMENT_TYPE),
                ],
                ["key", "doc_id", "plain_sha256", "words", "fragments"],
            )
            key += len(batch)

    return run


def stitched(fragments: DataFrame) -> DataFrame:
    """``key, start, length, period`` of each run: fragments (``key, period, start, end`` of matching
    words) of one key and period that overlap or touch are one; short ones go."""
    own = Window.partitionBy("key", "period")
    before = own.orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = own.orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    marked = fragments.withColumn("opens", (F.col("start") > F.coalesce(F.max("end").over(before), F.lit(-1))).cast("int"))
    groups = marked.withColumn("run", F.sum("opens").over(upto)).groupBy("key", "period", "run")
    runs = groups.agg(F.min("start").alias("start"), F.max("end").alias("end"))
    length = F.col("end") - F.col("start") + F.col("period")
    return runs.select("key", "start", length.alias("length"), "period").where(
        F.col("length") >= F.greatest(F.lit(LEAST_WORDS), LEAST_TIMES * F.col("period"))
    )


@tidy
def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs and words of documents to their digests."""
    for batch in portions(batches, 1):
        listed, kept_digests = [], []
        for text, runs in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            listed.append(hashlib.sha256("".join(f"{a},{n},{p}\n" for a, n, p in map(dict.values, runs)).encode()).hexdigest())
            words = pc.split_pattern(pa.array([text.as_py()], pa.string()), " ").flatten()
            step = np.zeros(len(words) + 1, np.int64)
            for run in runs:
                step[run["start"] + run["period"]] += 1
                step[run["start"] + run["length"]] -= 1
            left = words.filter(pa.array(np.cumsum(step[:-1]) == 0))
            kept_digests.append(hashlib.sha256(" ".join(left.to_pylist()).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(listed, pa.string()), pa.array(kept_digests, pa.string())],
            ["key", "runs_sha256", "collapsed_sha256"],
        )


def periodic_runs(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", plant: bool = False
) -> DataFrame:
    """``id_col, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256`` per row.

    The four after ``n_runs`` describe the longest run (ties: smallest start,
    then period) and are null without one. ``runs_sha256`` is the digest of every
    run's ``start,length,period`` and a line feed, by start, then period;
    ``collapsed_sha256`` that of the words, joined by spaces, without those that any run
    holds after its first period. With ``plant`` one document of ten, by the hash
    of its id's text, is first given a periodic end. Null and empty texts have no
    words. Repeated rows, also of one id, are each solved for itself; null ids are
    kept (and nothing is planted there). Other columns don't matter. An empty table gives no rows.
    """
    rows = documents.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(id_col).cast("string").alias("id_text")
    )
    id_type = rows.schema["doc_id"].dataType.simpleString()
    found = materialise(
        rows.mapInArrow(
            tidy(_find(plant)), f"key bigint, doc_id {id_type}, plain_sha256 string, words string, fragments {FRAGMENTS}"
        ),
        "periodic",
    )
    fragments = found.select("key", F.explode("fragments").alias("f")).select("key", "f.*")
    runs = stitched(fragments).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))
    runs = materialise(runs, "runs")
    longest = F.aggregate(
        "runs",
        F.col("runs")[0],
        lambda best, run: F.when(run["length"] > best["length"], run).otherwise(best),
    )
    told = runs.select("key", F.size("runs").cast("long").alias("n_runs"), longest.alias("longest"))
    digests = (
        found.where("words IS NOT NULL").select("key", "words").join(runs, "key")
        .mapInArrow(_collapse, "key bigint, runs_sha256 string, collapsed_sha256 string")
    )
    per_run = told.join(digests, "key")
    return (
        found.select("key", "doc_id", "plain_sha256")
        .join(per_run, "key", "left")
        .select(
            F.col("doc_id").alias(id_col),
            F.coalesce("n_runs", F.lit(0)).cast("long").alias("n_runs"),
            F.col("longest.start").alias("start"),
            F.col("longest.length").alias("length"),
            F.col("longest.period").alias("period"),
            F.expr("1000 * longest.length div longest.period").alias("exponent_milli"),
            F.coalesce("runs_sha256", F.sha2(F.lit(""), 256)).alias("runs_sha256"),
            F.coalesce("collapsed_sha256", "plain_sha256").alias("collapsed_sha256"),
        )
    )
