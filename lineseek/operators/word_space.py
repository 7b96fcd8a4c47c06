"""Word vectors from co-occurrence counts, by randomised subspace iteration.

1. Pairs of words at most ``window`` places apart are counted, weighted by positive
   pointwise mutual information: a sparse symmetric matrix. Words are numbers in it,
   and tiles of its counts are packed, some two bytes a pair.
2. A matrix of one short row per word, of random signs taken from the words' md5,
   is multiplied by it and made orthonormal, ``rounds`` times over. It then spans the
   directions in which the counts vary most.
3. A word's vector is its row of one more product.

Every step is a join, an aggregate or work on one tile. What reaches the driver is a matrix of
``dim`` by ``dim``, whatever the number of words. No draw depends on the order or
the partitions of the rows, so the same documents give the same vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineseek.functions.text import split_words
from lineseek.functions.vectors import dot_product, zero_vector
from lineseek.operators.portions import codes_of, packed, unpacked, with_words, word_portions, word_totals
from lineseek.session import materialise

DIM = 32
WINDOW = 4
MIN_COUNT = 5
ROUNDS = 2
BUCKETS = 1024  # of words, while they are numbered
STEP_WORDS = 1 << 19  # places of which pairs are formed at once
BLOCK_CELLS = 1 << 20  # of the vectors of a block of words
WIDEST = 1 << 16  # words along a side of a tile
TILE_PAIRS = 1 << 21  # pairs in the texts for each tile, on average
PAIRS = "held bigint, pairs binary, counts binary"
DIGITS = 32  # of an md5
DEPENDENT = 1e-10  # share of a column's square that must be left for it to count as a new direction


def _numbered(portions: DataFrame, min_count: int) -> DataFrame:
    """``word, n, number``: the words that occur ``min_count`` times, numbered from 0 without gaps.

    Numbers follow the words' hashes, so that any range of numbers holds frequent and rare words alike.
    """
    bucket = F.pmod(F.xxhash64("word"), F.lit(BUCKETS))
    frequent = word_totals(portions).where(F.col("word").isNotNull() & (F.col("n") >= min_count))
    frequent = materialise(frequent.select("word", "n", bucket.alias("bucket")), "words")
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    starts = frequent.groupBy("bucket").agg(F.count("*").alias("held")).select(
        "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start")
    )
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("word")) - 1
    numbered = frequent.withColumn("place", place).join(F.broadcast(starts), "bucket")
    return materialise(numbered.select("word", "n", (F.col("start") + F.col("place")).cast("int").alias("number")), "words")


class _Tiles:
    """Counts of pairs of numbered words, in square tiles of a symmetric table; the lesser number is left.

    A pair is one number, its place in its tile; a tile is one row of packed numbers. Tiles are so
    small that ``TILE_PAIRS`` of the pairs in the texts fall to one on average; a frequent word's
    pairs lie in as many tiles as there are blocks of words.
    """

    def __init__(self, portions: DataFrame, numbers: DataFrame, window: int, dim: int = 1):
        words, places = numbers.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        least = math.ceil(math.sqrt(2 * places * window / TILE_PAIRS))
        self.side = side = max(1, min(-(-words // max(1, least)), BLOCK_CELLS // dim, WIDEST))
        self.across = max(1, -(-words // side))
        self.words = words
        pieces = with_words(
            portions, numbers.select("word", "number"), _pairs_of_portion(window, side, self.across), f"tile bigint, {PAIRS}"
        )
        merged = pieces.groupBy("tile").applyInArrow(_merge_tile(side, self.across), f"tile bigint, {PAIRS}")
        self.rows = materialise(merged, "cooccurrences")

    def sums(self) -> DataFrame:
        """``word, n``: the counts of each word's pairs, added up in each task before they move."""
        side, across, words = self.side, self.across, self.words

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(words, np.int64)
            for batch in batches:
                for tile in range(len(batch)):
                    left, right, count = _pairs_of_tile(batch.slice(tile, 1), side, across)
                    for word, held in ((left, count), (right, np.where(left == right, 0, count))):
                        base = int(word.min(initial=words))
                        more = np.bincount(word - base, held).astype(np.int64)
                        total[base : base + len(more)] += more
            found = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["word", "n"])

        return self.rows.mapInArrow(add, "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n"))

    def counts(self) -> DataFrame:
        """``left, right, count`` by numbers."""
        side, across = self.side, self.across

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for tile in range(len(batch)):
                    left, right, count = _pairs_of_tile(batch.slice(tile, 1), side, across)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)), pa.array(count)],
                        ["left", "right", "count"],
                    )

        return self.rows.mapInArrow(rows, "left int, right int, count bigint")


def _pairs_of_portion(window: int, side: int, across: int):
    def count(portion: pa.Table, found: pa.Table) -> pa.Table:
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if portion.num_rows and found.num_rows:
            codes, row = codes_of(portion)
            numbers = np.full(int(codes.max()) + 2, -1, np.int64)  # the last one is for words without a code
            numbers[found["place"].to_numpy()] = found["number"].to_numpy()
            ids = numbers[codes]
            for start in range(0, len(ids), STEP_WORDS):
                made = []
                for distance in range(1, window + 1):
                    a, b = ids[start : start + STEP_WORDS], ids[start + distance : start + STEP_WORDS + distance]
                    near = row[start + distance : start + STEP_WORDS + distance]
                    a, same = a[: len(b)], row[start : start + len(b)] == near
                    held = same & (a >= 0) & (b >= 0)
                    a, b = a[held], b[held]
                    left, right = np.minimum(a, b), np.maximum(a, b)
                    made.append((left // side * across + right // side) * side**2 + left % side * side + right % side)
                more, times = np.unique(np.concatenate(made), return_counts=True)
                keys, sums = _added(np.append(keys, more), np.append(sums, times)) if len(keys) else (more, times)
        tiles = keys // side**2
        bounds = np.flatnonzero(np.diff(tiles, prepend=-1, append=-1))
        pieces = [(int(tiles[a]), keys[a:b] % side**2, sums[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
        return _packed_tiles(pieces)

    return count


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``keys`` in order, with their sums."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _packed_tiles(tiles: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    columns = {
        "tile": pa.array([tile for tile, _, _ in tiles], pa.int64()),
        "held": pa.array([len(keys) for _, keys, _ in tiles], pa.int64()),
        "pairs": pa.array([packed(np.diff(keys, prepend=0)) for _, keys, _ in tiles], pa.binary()),
        "counts": pa.array([packed(counts) for _, _, counts in tiles], pa.binary()),
    }
    return pa.table(columns)


def _merge_tile(side: int, across: int):
    def merge(pieces: pa.Table) -> pa.Table:
        held, pairs, counts = (pieces[name].to_pylist() for name in ("held", "pairs", "counts"))
        keys = np.concatenate([np.cumsum(unpacked(data, n)) for data, n in zip(pairs, held, strict=True)])
        keys, sums = _added(keys, np.concatenate([unpacked(data, n) for data, n in zip(counts, held, strict=True)]))
        tile = pieces["tile"][0].as_py()
        if tile // across == tile % across:
            sums = np.where(keys // side == keys % side, 2, 1) * sums
        return _packed_tiles([(tile, keys, sums)])

    return merge


def _pairs_of_tile(row: pa.RecordBatch | pa.Table, side: int, across: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left and right numbers, and counts."""
    held, above = row["held"][0].as_py(), divmod(row["tile"][0].as_py(), across)
    keys = np.cumsum(unpacked(row["pairs"][0].as_py(), held))
    return above[0] * side + keys // side, above[1] * side + keys % side, unpacked(row["counts"][0].as_py(), held)


def _portions_of(documents: DataFrame, column: str) -> DataFrame:
    return word_portions(documents.select(F.lit(0).alias("key"), F.col(column).alias("words")), "key", "words")


def cooccurrences(documents: DataFrame, column: str, window: int = WINDOW, min_count: int = MIN_COUNT) -> DataFrame:
    """``left, right, count`` over the token arrays in ``column``, a pair in one order of its words;
    a word next to itself counts twice, once for each direction.

    Words that occur less than ``min_count`` times make no pair but keep the others apart.
    Null arrays count as empty. Pairs are packed numbers, summed within each portion before they move.
    """
    portions = _portions_of(documents, column)
    numbers = _numbered(portions, min_count)
    pairs = _Tiles(portions, numbers, window).counts()
    for side in ("left", "right"):
        named = numbers.select(F.col("number").alias(side), F.col("word").alias(f"{side}_word"))
        pairs = pairs.join(named, side)
    one, other = F.col("left_word"), F.col("right_word")
    return pairs.select(F.least(one, other).alias("left"), F.greatest(one, other).alias("right"), "count")


def both_ways(pairs: DataFrame, value: str) -> DataFrame:
    """``word, context, value`` from ``left, right, value``, in both directions."""
    ways = F.array(
        F.struct(F.col("left").alias("word"), F.col("right").alias("context"), F.col(value)),
        F.struct(F.col("right").alias("word"), F.col("left").alias("context"), F.col(value)),
    )
    return pairs.select(F.inline(F.slice(ways, F.lit(1), F.when(F.col("left") == F.col("right"), 1).otherwise(2))))


def association(counts: DataFrame) -> DataFrame:
    """``left, right, weight``: ln(count * all / (left's * right's)), where it is above 0."""
    counts = materialise(counts, "cooccurrences")
    sums = materialise(both_ways(counts, "count").groupBy("word").agg(F.sum("count").alias("n")), "words")
    total = sums.agg(F.sum("n")).first()[0] or 0
    left, right = (sums.select(F.col("word").alias(side), F.col("n").alias(f"n_{side}")) for side in ("left", "right"))
    share = (F.col("count").cast("double") * F.lit(float(total))) / (F.col("n_left").cast("double") * F.col("n_right"))
    weighed = counts.join(left, "left").join(right, "right").select("left", "right", F.ln(share).alias("weight"))
    return weighed.where(F.col("weight") > 0)


def random_signs(word: Column, dim: int) -> Column:
    """An array of ``dim`` times 1 or -1, by the md5 digits of ``word:0``, ``word:1`` and so on."""
    blocks = range(-(-dim // DIGITS))
    digits = F.concat(*(F.md5(F.concat(word, F.lit(f":{block}"))) for block in blocks))
    return F.transform(
        F.sequence(F.lit(1), F.lit(dim)), lambda place: F.when(digits.substr(place, F.lit(1)) < "8", 1.0).otherwise(-1.0)
    )


class _Matrix:
    """The association of words, worked out from tiles of counts wherever it is multiplied.

    A tile meets the vectors and sums of the words along its two sides only; sums of
    a word leave a tile as one row.
    """

    def __init__(self, tiles: _Tiles, dim: int):
        self.tiles, self.dim = tiles, dim
        self.sums = materialise(tiles.sums(), "words")
        self.total = float(self.sums.agg(F.sum("n")).first()[0] or 0)

    def times(self, vectors: DataFrame) -> DataFrame:
        """``word, vector`` of the matrix times ``vectors``; words without an association above 0 have no row."""
        dim, side, across = self.dim, self.tiles.side, self.tiles.across
        vector = F.coalesce("vector", F.array_repeat(F.lit(0.0), dim))
        known = self.sums.join(vectors, "word", "left").select(
            F.floor(F.col("word") / side).alias("block"), "word", "n", vector.alias("vector")
        )
        blocks = materialise(
            known.groupBy("block").applyInArrow(_pack_block(dim, side), "block bigint, sums binary, vectors binary"), "vectors"
        )
        rows = self.tiles.rows
        ends = F.array_distinct(F.array(F.floor(F.col("tile") / across), F.col("tile") % across))
        mine = rows.select(F.col("tile").alias("of"), F.explode(ends).alias("block")).join(blocks, "block")
        made = rows.groupBy("tile").cogroup(mine.groupBy("of")).applyInArrow(
            _multiply(dim, side, across, self.total), "word int, vector array<double>"
        )
        sums = [F.sum(F.col("vector")[place]).alias(f"v{place}") for place in range(dim)]
        return made.groupBy("word").agg(*sums).select(
            "word", F.array(*(F.col(f"v{place}") for place in range(dim))).alias("vector")
        )


def _pack_block(dim: int, side: int):
    def pack(rows: pa.Table) -> pa.Table:
        place = rows["word"].to_numpy() % side
        sums, table = np.zeros(int(place.max()) + 1), np.zeros((int(place.max()) + 1, dim))
        sums[place] = rows["n"].to_numpy()
        table[place] = rows["vector"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
        columns = [rows["block"][:1], pa.array([sums.tobytes()]), pa.array([table.tobytes()])]
        return pa.table(columns, ["block", "sums", "vectors"])

    return pack


def _multiply(dim: int, side: int, across: int, total: float):
    def multiply(tile: pa.Table, blocks: pa.Table) -> pa.Table:
        words, made = [np.zeros(0, np.int64)], [np.zeros((0, dim))]
        if tile.num_rows and blocks.num_rows:
            held = {
                block: (np.frombuffer(sums), np.frombuffer(table).reshape(-1, dim))
                for block, sums, table in zip(*(blocks[n].to_pylist() for n in ("block", "sums", "vectors")), strict=True)
            }
            left, right, count = _pairs_of_tile(tile, side, across)
            above = [held[int(x[0]) // side] for x in (left, right)]
            share = count * total / (above[0][0][left % side] * above[1][0][right % side])
            near = np.flatnonzero(share > 1)
            left, right, weight = left[near], right[near], np.log(share[near])
            for own, other, table, by in (
                (left, right, above[1][1], weight), (right, left, above[0][1], np.where(left == right, 0, weight)),
            ):
                if len(own):
                    least, place = int(own.min()), other % side
                    met = np.flatnonzero(np.bincount(own - least))
                    sums = [np.bincount(own - least, by * table[place, d])[met] for d in range(dim)]
                    words.append(met + least)
                    made.append(np.stack(sums, axis=1))
        words, made = np.concatenate(words), np.concatenate(made)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1) * dim, pa.int32()), pa.array(made.ravel()))
        return pa.table({"word": pa.array(words, pa.int32()), "vector": lists})

    return multiply


def _orthonormal(vectors: DataFrame, dim: int) -> DataFrame:
    """``vectors`` with columns made orthonormal in order; one that depends on those before is 0."""
    parts = vectors.select("vector", F.posexplode("vector").alias("place", "factor"))
    sums = [F.sum(F.col("factor") * F.col("vector")[place]) for place in range(dim)]
    gram = np.zeros((dim, dim))
    for row in parts.groupBy("place").agg(F.array(*sums).alias("products")).collect():  # dim rows
        gram[row.place] = row.products
    columns = _triangular(gram)
    weights = F.array(*(F.array(*(F.lit(float(x)) for x in columns[:, place])) for place in range(dim)))
    return vectors.select("word", F.transform(weights, lambda column: dot_product(F.col("vector"), column)).alias("vector"))


def _triangular(gram: np.ndarray) -> np.ndarray:
    """Upper triangular T for which Y T is orthonormal, from Y's products of columns."""
    dim = len(gram)
    made = np.zeros((dim, dim))
    for place in range(dim):
        column = np.zeros(dim)
        column[place] = 1.0
        for _ in range(2):  # the second time takes out what rounding left
            column -= made @ (made.T @ (gram @ column))
        left = column @ gram @ column
        if left > DEPENDENT * gram[place, place]:
            made[:, place] = column / np.sqrt(left)
    return made


def word_space(
    documents: DataFrame,
    column: str,
    *,
    dim: int = DIM,
    window: int = WINDOW,
    min_count: int = MIN_COUNT,
    rounds: int = ROUNDS,
) -> DataFrame:
    """``word, vector`` (floats) for the words of the token arrays in ``column`` that occur
    ``min_count`` times and next to another such word more often than by chance.

    An empty table, or one without such words, gives no rows. Repeated documents
    count as often as they occur; other columns don't matter.
    """
    portions = _portions_of(documents, column)
    numbers = _numbered(portions, min_count)
    matrix = _Matrix(_Tiles(portions, numbers, window, dim), dim)
    named = numbers.select(F.col("number").alias("word"), F.col("word").alias("name"))
    vectors = named.select("word", random_signs(F.col("name"), dim).alias("vector"))
    for _ in range(rounds):
        product = materialise(matrix.times(vectors), "vectors")
        vectors = _orthonormal(product, dim)
    found = matrix.times(vectors).join(named, "word").select(
        F.col("name").alias("word"), F.col("vector").cast("array<float>").alias("vector")
    )
    return materialise(found, "vectors")


def _sums_of_rows(dim: int):
    def add(portion: pa.Table, found: pa.Table) -> pa.Table:
        if not portion.num_rows or not found.num_rows:
            return pa.table([pa.array([], portion["keys"].type.value_type), pa.array([], pa.int64()),
                             pa.array([], pa.list_(pa.float64()))], ["key", "total", "vector"])
        codes, row = codes_of(portion)
        place, lists = found["place"].to_numpy(), found["vector"].combine_chunks()
        values, copies = np.zeros((int(codes.max()) + 2, dim)), np.zeros(int(codes.max()) + 2, np.int64)
        np.add.at(values, place, lists.flatten().to_numpy().reshape(-1, dim))
        np.add.at(copies, place, 1)
        keys = portion["keys"].combine_chunks().flatten()
        totals = np.bincount(row, copies[codes], len(keys)).astype(np.int64)
        sums = np.stack([np.bincount(row, values[codes, d], len(keys)) for d in range(dim)], axis=1)
        held = np.flatnonzero(totals)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1) * dim, pa.int32()), pa.array(sums[held].ravel()))
        return pa.table([keys.take(pa.array(held)), pa.array(totals[held]), lists], ["key", "total", "vector"])

    return add


def embed_by_words(vectors: DataFrame, texts: DataFrame, key: str = "id", dim: int = DIM) -> DataFrame:
    """``<key>, vec`` from ``<key>, text``: the mean of the vectors of a processed text's
    words, repeated ones counted, unknown ones left out; zeros if all are. Keys are to be unique.

    A word's vector goes once to each portion of texts, and a text's sum is one row."""
    rows = texts.select(F.col(key).alias("key"), split_words(F.col("text")).alias("words"))
    portions = word_portions(rows, "key", "words")
    key_type = rows.schema["key"].dataType.simpleString()
    added = with_words(portions, vectors.select("word", "vector"), _sums_of_rows(dim), f"key {key_type}, total bigint, vector array<double>")
    sums = [F.sum(F.col("vector")[place]).alias(f"v{place}") for place in range(dim)]
    means = added.groupBy(F.col("key").alias(key)).agg(F.sum("total").alias("total"), *sums)
    found = means.select(
        F.col(key).alias("_key"), F.array(*((F.col(f"v{place}") / F.col("total")) for place in range(dim))).alias("vec")
    )
    joined = texts.select(key).join(found, F.col(key) == F.col("_key"), "left")
    return joined.select(key, F.coalesce("vec", zero_vector(dim).cast("array<double>")).alias("vec"))
