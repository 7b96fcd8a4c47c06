"""Best-fit packing: token sequences filled by a configuration linear program.

Only the histogram of piece lengths (at most one count per length) comes to
the driver. A configuration is a multiset of lengths that fits one sequence.
Multiplicative weights solve the covering program over configurations: lengths
that are covered too little gain weight, and a knapsack dynamic program finds
the configurations of most weight. The fractional solution is rounded down,
what is left is solved again, and the last rest is packed best-fit decreasing.
The plan is a table of slots; every piece finds its slot by length and rank.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineseek.llm.tokens import default_tokenizer, drop_shared_encoder, id_lists, portions, shared_encoder, with_end
from lineseek.llm.work import materialise, shuffle_partitions, tidy

SEQUENCE_TOKENS = 2048
PRICINGS, CONFIGS_PER_PRICING, PASSES = 40, 48, 3
CUT_BYTES, CUT_WORDS = 1 << 20, 100_000  # texts encoded at once, and words a worker remembers meanwhile
KEPT_BYTES, KEPT_WORDS = 2 << 20, 600_000  # the same where a worker keeps its encoder
STEP = 0.5  # share of a length's demand that one configuration may cover at a step

Config = tuple[tuple[int, int], ...]  # (length, copies), longest first


def knapsack(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value within each capacity, with repetition, and the item added last (-1: none)."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fitting = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room], last[room] = best[room - 1], -1
        if n := fitting[room]:
            sums = best[room - lengths[:n]] + values[:n]
            k = int(sums.argmax())
            if sums[k] > best[room]:
                best[room], last[room] = sums[k], k
    return best, last


def _filled(first: int, last: np.ndarray, lengths: np.ndarray, capacity: int, demand: np.ndarray) -> Counter:
    """Item ``first`` and the best content of the room left, at most as often as demanded."""
    items, room = Counter([first]), capacity - int(lengths[first])
    while room > 0:
        k = int(last[room])
        if k < 0:
            room -= 1
            continue
        if items[k] < demand[k]:
            items[k] += 1
        room -= int(lengths[k])
    return items


def fractional(demand: np.ndarray, lengths: np.ndarray, capacity: int) -> dict[Config, float]:
    """Configurations with fractional use, such that no length is used beyond its demand."""
    covered, use = np.zeros(len(lengths)), defaultdict(float)
    for _ in range(PRICINGS):
        weights = np.exp(-4.0 * (covered - covered.min()))
        _, last = knapsack(weights * lengths / capacity + 1e-12, lengths, capacity)
        for first in np.argsort(covered, kind="stable")[:CONFIGS_PER_PRICING]:
            items = _filled(int(first), last, lengths, capacity, demand)
            step = STEP * min(demand[k] / copies for k, copies in items.items())
            config = tuple(sorted(((int(lengths[k]), copies) for k, copies in items.items()), reverse=True))
            use[config] += step
            for k, copies in items.items():
                covered[k] += step * copies / demand[k]
    over = max(1.0, covered.max())
    return {config: amount / over for config, amount in use.items()}


def best_fit_decreasing(left: Counter, capacity: int) -> Counter:
    """Configurations for the rest, longest first, each into the fullest sequences that take it."""
    open_: dict[int, Counter] = defaultdict(Counter)  # room left -> configurations
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            room = min((r for r, held in open_.items() if r >= length and held), default=None)
            if room is None:
                fit = capacity // length
                whole, rest = divmod(n, fit)
                if whole:
                    open_[capacity - fit * length][((length, fit),)] += whole
                if rest:
                    open_[capacity - rest * length][((length, rest),)] += 1
                break
            config, many = next(iter(open_[room].items()))
            copies = min(room // length, n)
            taken = min(many, n // copies)
            open_[room][config] -= taken
            if not open_[room][config]:
                del open_[room][config]
            open_[room - copies * length][(*config, (length, copies))] += taken
            n -= taken * copies
    return sum(open_.values(), Counter())


def plan_sequences(histogram: Mapping[int, int], capacity: int = SEQUENCE_TOKENS) -> Counter:
    """Configurations with whole multiplicities that use up ``histogram`` exactly."""
    left, plan = Counter({int(k): int(v) for k, v in histogram.items() if v}), Counter()
    if left[capacity]:
        plan[((capacity, 1),)] = left.pop(capacity)
    for _ in range(PASSES):
        lengths = np.array(sorted(left), np.int64)
        if not len(lengths):
            break
        demand = np.array([left[int(k)] for k in lengths], float)
        for config, amount in fractional(demand, lengths, capacity).items():
            if sum(k * c for k, c in config) < capacity * 0.995:
                continue  # poorly filled ones wait for the rest
            whole = min(int(amount + 0.5), *(left[k] // c for k, c in config))
            if whole > 0:
                plan[config] += whole
                for k, c in config:
                    left[k] -= whole * c
        left = +left
    return plan + best_fit_decreasing(left, capacity)


def slot_table(plan: Mapping[Config, int]) -> list[tuple[int, int, int, int, int, int]]:
    """``length, first_rank, end_rank, first_sequence, copies, offset``: the pieces of
    a length, by rank, and the sequences they go to."""
    rows, ranks, sequences = [], Counter(), 0
    for config, many in plan.items():
        offset = 0
        for length, copies in config:
            rows.append((length, ranks[length], ranks[length] + copies * many, sequences, copies, offset))
            ranks[length] += copies * many
            offset += length * copies
        sequences += many
    return rows


def token_pieces(
    documents: DataFrame,
    *,
    tokenizer: str | None = None,
    end_id: int = 0,
    capacity: int = SEQUENCE_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
    keep_encoder: bool = False,
) -> DataFrame:
    """``id_col, piece, start, length, ids_crc32[, ids]``: each text's ids with
    ``end_id``, cut into pieces of ``capacity`` where longer.

    With ``keep_encoder`` a worker keeps its encoder and remembers more words (some 120 MB):
    that takes little more than half of the CPU, where no other stage needs the memory.
    """
    tokenizer = tokenizer or default_tokenizer()
    cut_bytes, cut_words = (KEPT_BYTES, KEPT_WORDS) if keep_encoder else (CUT_BYTES, CUT_WORDS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer, cut_words)
        try:
            for batch in portions(batches, 1, cut_bytes):
                ids, bounds = with_end(*encoder.encode(batch.column(1)), end_id)
                pieces = -(-np.diff(bounds) // capacity)
                document = np.repeat(np.arange(len(batch)), pieces)
                piece = np.arange(len(document)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = bounds[document] + piece * capacity
                end = np.minimum(start + capacity, bounds[document + 1])
                raw = memoryview(ids).cast("B")
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(start, end, strict=True)]
                columns = [
                    batch.column(0).take(pa.array(document)),
                    pa.array(piece.astype(np.int32)),
                    pa.array(piece * capacity),
                    pa.array(end - start),
                    pa.array(sums, pa.int64()),
                ]
                if with_ids:
                    columns.append(id_lists(ids, np.append(start, len(ids))))
                yield pa.RecordBatch.from_arrays(columns, names)
        finally:
            if not keep_encoder:
                drop_shared_encoder()

    names = ["id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return rows.mapInArrow(tidy(cut), schema + (", ids array<int>" if with_ids else "")).withColumnRenamed("id", id_col)


def pack_pieces(pieces: DataFrame, *, capacity: int = SEQUENCE_TOKENS, id_col: str = "doc_id") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.

    Ranks are given within (length, part of the ids' hash) and carried on by
    the parts' counts, so a length that most pieces share is many tasks' work.
    The slots are at most a few rows per length and pricing step, whatever the
    number of pieces; that table is broadcast.
    """
    spark = pieces.sparkSession
    counts = {row["length"]: row["count"] for row in pieces.groupBy("length").count().collect()}
    slots = spark.createDataFrame(
        slot_table(plan_sequences(counts, capacity)),
        "slot_length bigint, first_rank bigint, end_rank bigint, first_sequence bigint, copies bigint, slot_offset bigint",
    )
    part = F.pmod(F.xxhash64(F.struct(id_col, "piece")), F.lit(shuffle_partitions(spark)))
    parted = pieces.select("*", part.alias("part"))
    sizes = parted.groupBy(F.col("length").alias("l"), F.col("part").alias("p")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("l").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("l", "p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank_start"))
    within = Window.partitionBy("length", "part").orderBy(id_col, "piece", "ids_crc32")
    ranked = parted.withColumn("rank_in_part", F.row_number().over(within) - 1)
    ranked = ranked.join(starts, (F.col("length") == F.col("l")) & (F.col("part") == F.col("p")))
    ranked = ranked.withColumn("rank", F.col("rank_start") + F.col("rank_in_part"))
    placed = ranked.join(
        F.broadcast(slots),
        (F.col("length") == F.col("slot_length"))
        & (F.col("rank") >= F.col("first_rank"))
        & (F.col("rank") < F.col("end_rank")),
    )
    turn = F.col("rank") - F.col("first_rank")
    return placed.select(
        *pieces.columns,
        (F.col("first_sequence") + F.floor(turn / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("slot_offset") + F.pmod(turn, F.col("copies")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(documents: DataFrame, *, capacity: int = SEQUENCE_TOKENS, **options) -> DataFrame:
    """``id_col, piece, start, length, ids_crc32[, ids], sequence_id, offset`` per piece.

    A null or empty text is its end id alone. Repeated rows are packed each.
    Null ids are kept as they are. Other columns don't matter. An empty table
    gives no rows.
    """
    id_col = options.get("id_col", "doc_id")
    pieces = materialise(token_pieces(documents, capacity=capacity, **options), "pieces")
    return pack_pieces(pieces, capacity=capacity, id_col=id_col)
