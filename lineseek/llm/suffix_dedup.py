"""Suffix-array deduplication: bytes covered by a string of 100 bytes that also starts earlier.

Blockwise, with a difference cover, so that no task ever sorts the suffixes of
more than one bucket:

1. Texts are packed in compressed blocks of a few MB, written once.
2. Cover sample. The places p with p mod 73 in a perfect difference set of nine
   residues are sampled: any two places i and j have an offset below 73 at which
   both are sampled. A sample's string of 28 bytes is ranked against all others
   (a bucket of ranks at a time), and each block learns which of its samples tie.
   Two suffixes that agree for 100 bytes agree in one pair of sample strings, so
   a suffix over no tied sample ties with nothing and is settled.
3. Suffix buckets. The suffixes left are dealt to buckets by the least-hashed
   37-byte string among those they begin with (equal beginnings of 100 bytes
   share it). Suffixes with a common such string travel as one context of at
   most 163 bytes. A block first resolves the ties inside itself, so a passage in a
   third of all documents is sent about once per block.
4. A bucket's suffixes are sorted by the hash of their first 100 bytes, ties are
   confirmed byte by byte, and all but the earliest of each tie are marked.
5. The marks go back to the blocks, whose documents are cut.

Whole texts equal to an earlier one are marked beforehand by their digest: each
of their suffixes ties with the same place of that text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineseek.llm.rolling import Hashed, mixed, utf8
from lineseek.llm.work import materialise, shuffle_partitions, tidy, tidy_cogroup, tidy_group

LENGTH = 100
#: A perfect difference set modulo 73.
COVER_PERIOD, COVER = 73, (0, 1, 3, 7, 15, 31, 36, 54, 63)
SAMPLE_BYTES = LENGTH - COVER_PERIOD + 1
GRAM = 37
LEFT = LENGTH - GRAM  # how far before its gram a suffix may begin
CONTEXT = LEFT + LENGTH
BLOCK_BYTES = 4 << 20
NO_ID = np.iinfo(np.int64).max
CODEC = "zstd"
SAMPLES, COPIES, CONTEXTS, MARKS = 0, 1, 2, 3

BLOCK_SCHEMA = "block bigint, ids binary, known binary, bounds binary, data binary, size bigint"
PART_SCHEMA = "block bigint, bucket int, kind int, size bigint, places binary, keys binary, masks binary, contexts binary"
PARTS = [field.split()[0] for field in PART_SCHEMA.split(", ")]


def packed(values: np.ndarray) -> bytes:
    return pa.Codec(CODEC, compression_level=6).compress(np.ascontiguousarray(values).tobytes(), asbytes=True)


def unpacked(raw: bytes, kind: type, size: int) -> np.ndarray:
    width = np.dtype(kind).itemsize * size
    return np.frombuffer(pa.Codec(CODEC).decompress(raw, width, asbytes=True), kind)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [field.split() for field in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(column, kinds[kind]) for column, (_, kind) in zip(columns, fields, strict=True)],
        [name for name, _ in fields],
    )


# 1. blocks


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        data, bounds = utf8(batch.column(1))
        ids = batch.column(0)
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(NO_ID).to_numpy()
        group = bounds[:-1] // BLOCK_BYTES
        firsts = np.flatnonzero(np.diff(group, prepend=-1))
        for first, last in zip(firsts, [*firsts[1:], len(ids)], strict=True):
            part = data[bounds[first] : bounds[last]]
            row = (
                number, ids[first:last].tobytes(), known[first:last].tobytes(),
                (bounds[first : last + 1] - bounds[first]).tobytes(), packed(part), len(part),
            )
            yield _batch([row], BLOCK_SCHEMA)
            number += 1


class Block:
    def __init__(self, row: dict):
        self.number = row["block"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.known = np.frombuffer(row["known"], bool)
        self.bounds = np.frombuffer(row["bounds"], np.int64)
        self.data = unpacked(row["data"], np.uint8, row["size"])

    def inside(self, length: int) -> np.ndarray:
        """For each place: does a string of ``length`` bytes starting there end in its document?"""
        steps = np.zeros(len(self.data) + 1, np.int32)
        ends = self.bounds[1:] - length + 1
        full = ends > self.bounds[:-1]
        np.add.at(steps, self.bounds[:-1][full], 1)
        np.add.at(steps, ends[full], -1)
        return np.cumsum(steps[:-1]) > 0

    def samples(self, hashed: Hashed) -> tuple[np.ndarray, np.ndarray]:
        """Places of the cover sample, and their strings' hashes."""
        periods = np.arange(0, len(self.data), COVER_PERIOD)
        places = (periods[:, None] + np.array(COVER)[None, :]).ravel()
        places = places[places + SAMPLE_BYTES <= len(self.data)]
        places = places[self.inside(SAMPLE_BYTES)[places]]
        return places, mixed(hashed.ranges(places, places + SAMPLE_BYTES))


def _by_bucket(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by bucket (the top bits), the buckets present and where each begins."""
    buckets = (hashes >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)  # two bytes sort faster
    order = np.argsort(buckets, kind="stable")
    starts = np.flatnonzero(np.diff(buckets[order].astype(np.int64), prepend=-1))
    return order, buckets[order][starts].astype(int), starts


def _parts(starts: np.ndarray, size: int) -> Iterator[slice]:
    for start, end in zip(starts, [*starts[1:], size], strict=True):
        yield slice(int(start), int(end))


# 2. cover sample


def _sample(bits: int):
    """Sample hashes of each block by bucket, in the order of their places; digests of its documents."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                _, hashes = block.samples(Hashed(block.data))
                order, buckets, starts = _by_bucket(hashes, bits)
                low = (hashes[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                rows = [
                    (block.number, bucket, SAMPLES, part.stop - part.start, None, low[part].tobytes(), None, None)
                    for bucket, part in zip(buckets, _parts(starts, len(low)), strict=True)
                ]
                whole = np.flatnonzero(np.diff(block.bounds) >= LENGTH)
                digests = [
                    hashlib.blake2b(block.data[block.bounds[i] : block.bounds[i + 1]], digest_size=16).digest()
                    for i in whole
                ]
                pairs = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
                order, buckets, starts = _by_bucket(pairs[:, 0], bits)
                for bucket, part in zip(buckets, _parts(starts, len(order)), strict=True):
                    mine = order[part]
                    rows.append(
                        (block.number, bucket, COPIES, len(mine), whole[mine].astype(np.int32).tobytes(),
                         pairs[mine].tobytes(), None, block.ids[whole[mine]].tobytes())
                    )
                yield _batch(rows, PART_SCHEMA)

    return sample


def _rank(parts: pa.Table) -> pa.Table:
    """Which samples of a bucket tie with another, a bit each; which documents have an earlier copy."""
    rows, out = parts.to_pylist(), []
    mine = [row for row in rows if row["kind"] == SAMPLES]
    if mine:
        values = np.concatenate([np.frombuffer(row["keys"], np.uint32) for row in mine])
        ranked = np.sort(values)
        tied = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
        flags = np.zeros(len(values), bool)
        if len(tied):
            flags = tied[np.minimum(np.searchsorted(tied, values), len(tied) - 1)] == values
        upto = np.concatenate([[0], np.cumsum([row["size"] for row in mine])])
        for row, start, end in zip(mine, upto[:-1], upto[1:], strict=True):
            out.append((row["block"], row["bucket"], SAMPLES, row["size"], None,
                        np.packbits(flags[start:end]).tobytes(), None, None))
    mine = [row for row in rows if row["kind"] == COPIES]
    if mine:
        digests = np.concatenate([np.frombuffer(row["keys"], np.uint64).reshape(-1, 2) for row in mine])
        ids = np.concatenate([np.frombuffer(row["contexts"], np.int64) for row in mine])
        places = np.concatenate([np.frombuffer(row["places"], np.int32) for row in mine])
        blocks = np.repeat([row["block"] for row in mine], [row["size"] for row in mine])
        order = np.lexsort((places, blocks, ids, digests[:, 1], digests[:, 0]))
        again = np.zeros(len(order), bool)
        again[1:] = (digests[order][1:] == digests[order][:-1]).all(axis=1)
        late = np.sort(order[again])
        for number in np.unique(blocks[late]):
            found = places[late[blocks[late] == number]]
            out.append((number, -1, COPIES, len(found), found.tobytes(), None, None, None))
    return pa.Table.from_batches([_batch(out, PART_SCHEMA)])


# 3. suffix buckets


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    held, out = 1, values
    while held < width:
        step = min(held, width - held)
        out = np.minimum(out[: len(out) - step], out[step:])
        held += step
    return out


def anchors(block: Block, hashed: Hashed, tied: np.ndarray, copies: np.ndarray):
    """For the unsettled suffixes: the places of their least grams, the grams' hashes,
    and in a mask bit l: the suffix l bytes before the gram is one of them."""
    size = len(block.data)
    steps = np.zeros(size + 1, np.int32)
    np.add.at(steps, np.maximum(tied - (COVER_PERIOD - 1), 0), 1)
    np.add.at(steps, tied + 1, -1)
    open_ = (np.cumsum(steps[:-1]) > 0) & block.inside(LENGTH)
    for copy in copies:
        open_[block.bounds[copy] : block.bounds[copy + 1]] = False
    suffixes = np.flatnonzero(open_)
    if not len(suffixes):
        return suffixes, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    grams = mixed(hashed.windows(GRAM))
    place_bits = np.uint64(int(size).bit_length())
    low = (np.uint64(1) << place_bits) - np.uint64(1)
    keyed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    least = (sliding_least(keyed, LEFT + 1)[suffixes] & low).astype(np.int64)
    starts = np.flatnonzero(np.diff(least, prepend=-1))
    masks = np.bitwise_or.reduceat(np.uint64(1) << (least - suffixes).astype(np.uint64), starts)
    return least[starts], grams[least[starts]], masks


def contexts_of(data: np.ndarray, places: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """The bytes around each gram that its suffixes need; others are 0."""
    around = np.concatenate([np.zeros(LEFT, np.uint8), data, np.zeros(LENGTH, np.uint8)])
    contexts = around[places[:, None] + np.arange(CONTEXT)[None, :]]
    bits = np.unpackbits(masks.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    nearest, farthest = bits.argmax(axis=1), 63 - bits[:, ::-1].argmax(axis=1)
    column = np.arange(CONTEXT)[None, :]
    contexts[(column < (LEFT - farthest)[:, None]) | (column >= (CONTEXT - nearest)[:, None])] = 0
    return contexts


def resolve(contexts: np.ndarray, masks: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The part of each mask whose suffixes tie with one of lower rank.

    Suffixes that tie stand at the same distance before their grams; the rank
    orders their contexts by document and place.
    """
    late = np.zeros(len(masks), np.uint64)
    if len(masks) < 2:
        return late
    grams = np.zeros(len(masks), np.uint64)
    factors = np.random.default_rng(GRAM).integers(0, 1 << 63, GRAM, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for place in range(GRAM):
        grams += (contexts[:, LEFT + place].astype(np.uint64) + np.uint64(1)) * factors[place]
    ordered = np.sort(grams)
    tied = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(tied):
        return late
    held = np.flatnonzero(tied[np.minimum(np.searchsorted(tied, grams), len(tied) - 1)] == grams)
    owner, back, keys = [], [], []
    for chunk in np.array_split(held, -(-len(held) // 4096)):
        bits = np.unpackbits(masks[chunk].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, distance = np.nonzero(bits)
        flat = Hashed(contexts[chunk].ravel())
        start = row * CONTEXT + LEFT - distance
        owner.append(chunk[row])
        back.append(distance.astype(np.int64))
        keys.append(mixed(flat.ranges(start, start + LENGTH)))
    owner, back, keys = np.concatenate(owner), np.concatenate(back), np.concatenate(keys)

    order = np.argsort(keys)
    keys = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[1:] == keys[:-1]
    order = order[same[:-1] | same[1:]]
    if not len(order):
        return late
    firsts = np.flatnonzero(~same[:-1][same[:-1] | same[1:]])
    earliest = np.minimum.reduceat(ranks[owner[order]], firsts)
    sizes = np.diff(firsts, append=len(order))
    by_rank = np.empty(len(ranks), np.int64)
    by_rank[ranks] = np.arange(len(ranks))
    head = np.repeat(by_rank[earliest], sizes)
    mine = owner[order]

    data = np.concatenate([contexts.ravel(), np.zeros(8, np.uint8)])
    words = np.ndarray((len(data) - 7,), np.uint64, data, 0, (1,))  # eight bytes from each place
    equal = np.ones(len(order), bool)
    start, other = mine * CONTEXT + LEFT - back[order], head * CONTEXT + LEFT - back[order]
    for place in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        equal &= words[start + place] == words[other + place]
    head_has = (masks[head] >> back[order].astype(np.uint64)) & np.uint64(1) == 1
    if not (equal & head_has).all():
        return _resolve_bytes(contexts, masks, ranks)
    marked = order[mine != head]
    marked.sort()
    if len(marked):
        starts = np.flatnonzero(np.diff(owner[marked], prepend=-1))
        late[owner[marked][starts]] = np.bitwise_or.reduceat(np.uint64(1) << back[marked].astype(np.uint64), starts)
    return late


def _resolve_bytes(contexts: np.ndarray, masks: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The same without hashes, for the case that two strings share one."""
    late, met = np.zeros(len(masks), np.uint64), set()
    for place in np.argsort(ranks):
        for distance in range(LEFT, -1, -1):
            if int(masks[place]) >> distance & 1:
                string = contexts[place, LEFT - distance : LEFT - distance + LENGTH].tobytes()
                if string in met:
                    late[place] |= np.uint64(1 << distance)
                met.add(string)
    return late


def _ranks(ids: np.ndarray, blocks: np.ndarray, places: np.ndarray) -> np.ndarray:
    ranks = np.empty(len(ids), np.int64)
    ranks[np.lexsort((places, blocks, ids))] = np.arange(len(ids))
    return ranks


def _marks(block: int, bucket: int, places: np.ndarray, masks: np.ndarray) -> list[tuple]:
    some = masks != 0
    if not some.any():
        return []
    return [(block, bucket, MARKS, int(some.sum()), packed(places[some].astype(np.int32)), None, packed(masks[some]), None)]


def _deal(bits: int):
    """Contexts of a block's unsettled suffixes by bucket, and the marks it can give itself."""

    def deal(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row in blocks.to_pylist():
            block = Block(row)
            hashed = Hashed(block.data)
            places, hashes = block.samples(hashed)
            order, buckets, starts = _by_bucket(hashes, bits)
            flags, copies = {}, np.zeros(0, np.int64)
            copied = []
            for answer in answers.to_pylist():
                if answer["kind"] == SAMPLES:
                    flags[answer["bucket"]] = np.unpackbits(
                        np.frombuffer(answer["keys"], np.uint8), count=answer["size"]
                    )
                else:
                    copied.append(np.frombuffer(answer["places"], np.int32))
                    out.append(tuple(answer[name] for name in PARTS))
            if copied:
                copies = np.concatenate(copied)
            tied = np.concatenate([np.zeros(0, np.uint8), *(flags[bucket] for bucket in buckets)]).astype(bool)
            at, grams, masks = anchors(block, hashed, np.sort(places[order[tied]]), copies)
            if not len(at):
                continue
            ids = block.ids[np.searchsorted(block.bounds, at, side="right") - 1]
            contexts = contexts_of(block.data, at, masks)
            late = resolve(contexts, masks, _ranks(ids, np.zeros(len(at)), at))
            out += _marks(block.number, -1, at, late)
            left = np.flatnonzero(masks & ~late)
            at, grams, masks, ids = at[left], grams[left], (masks & ~late)[left], ids[left]
            order, buckets, starts = _by_bucket(mixed(grams), bits)
            for bucket, part in zip(buckets, _parts(starts, len(order)), strict=True):
                mine = order[part]
                out.append(
                    (block.number, bucket, CONTEXTS, len(mine), packed(at[mine].astype(np.int32)), packed(ids[mine]),
                     packed(masks[mine]), packed(contexts_of(block.data, at[mine], masks[mine])))
                )
        return pa.Table.from_batches([_batch(out, PART_SCHEMA)])

    return deal


# 4. one bucket


def _sort_bucket(parts: pa.Table) -> pa.Table:
    """Marks of one bucket's suffixes; marks and copies that blocks found themselves pass through."""
    rows = parts.to_pylist()
    out = [tuple(row.values()) for row in rows if row["kind"] != CONTEXTS]
    rows = [row for row in rows if row["kind"] == CONTEXTS]
    if rows:
        sizes = [row["size"] for row in rows]
        places = np.concatenate([unpacked(row["places"], np.int32, row["size"]) for row in rows])
        ids = np.concatenate([unpacked(row["keys"], np.int64, row["size"]) for row in rows])
        masks = np.concatenate([unpacked(row["masks"], np.uint64, row["size"]) for row in rows])
        contexts = np.concatenate([unpacked(row["contexts"], np.uint8, row["size"] * CONTEXT) for row in rows])
        blocks = np.repeat([row["block"] for row in rows], sizes)
        late = resolve(contexts.reshape(-1, CONTEXT), masks, _ranks(ids, blocks, places))
        upto = np.concatenate([[0], np.cumsum(sizes)])
        for row, start, end in zip(rows, upto[:-1], upto[1:], strict=True):
            out += _marks(row["block"], row["bucket"], places[start:end], late[start:end])
    return pa.Table.from_batches([_batch(out, PART_SCHEMA)])


# 5. cutting


def covered(block: Block, marks: list[dict]) -> np.ndarray:
    """For each byte of the block: is it removed?"""
    steps = np.zeros(len(block.data) + 1, np.int32)
    for row in marks:
        if row["kind"] == COPIES:
            copies = np.frombuffer(row["places"], np.int32)
            np.add.at(steps, block.bounds[copies], 1)
            np.add.at(steps, block.bounds[copies + 1], -1)
        else:
            places = unpacked(row["places"], np.int32, row["size"])
            masks = unpacked(row["masks"], np.uint64, row["size"])
            bits = np.unpackbits(masks.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row_of, distance = np.nonzero(bits)
            starts = places[row_of] - distance
            np.add.at(steps, starts, 1)
            np.add.at(steps, starts + LENGTH, -1)
    return np.cumsum(steps[:-1]) > 0


def _cut(with_text: bool):
    def cut(blocks: pa.Table, marks: pa.Table) -> pa.Table:
        tables = []
        for row in blocks.to_pylist():
            block = Block(row)
            gone = covered(block, marks.to_pylist())
            n = len(block.ids)
            sizes = np.diff(block.bounds)
            removed, spans, kept = np.zeros(n, np.int64), np.zeros(n, np.int64), []
            for i in range(n):
                part = slice(block.bounds[i], block.bounds[i + 1])
                mine = gone[part]
                if mine.any():
                    removed[i] = mine.sum()
                    spans[i] = mine[0] + np.count_nonzero(mine[1:] & ~mine[:-1])
                    kept.append(block.data[part][~mine].tobytes())
                else:
                    kept.append(block.data[part].tobytes())
            columns = {
                "id": pa.array(block.ids, mask=~block.known),
                "n_bytes": pa.array(sizes),
                "n_removed": pa.array(removed),
                "n_spans": pa.array(spans),
                "kept_sha256": pa.array([hashlib.sha256(raw).hexdigest() for raw in kept]),
            }
            if with_text:
                columns["kept"] = pa.array(kept, pa.binary())
            tables.append(pa.table(columns))
        return pa.concat_tables(tables) if tables else pa.table(
            {name: pa.array([], kind) for name, kind in _cut_types(with_text)}
        )

    return cut


def _cut_types(with_text: bool) -> list[tuple[str, pa.DataType]]:
    kinds = [("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
             ("kept_sha256", pa.string())]
    return kinds + ([("kept", pa.binary())] if with_text else [])


def remove_repeats(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False
) -> DataFrame:
    """``id_col, n_bytes, n_removed, n_spans, kept_sha256[, kept]`` for every row.

    Removed is each byte covered by a string of 100 bytes of the same document
    that also starts earlier: in a row with a smaller id, or earlier in the
    same row; all strings are judged on the input. ``n_spans`` counts maximal
    runs removed, ``kept`` holds the bytes left. Null texts are empty. Rows with
    a null id come after all others; rows with equal ids count in the order
    in which they were read. Other columns don't matter. An empty table gives no rows.
    """
    spark = documents.sparkSession
    bits = max(4, int(np.ceil(np.log2(shuffle_partitions(spark)))) + 2)  # four buckets or more to a partition
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    blocks = materialise(rows.mapInArrow(_pack, BLOCK_SCHEMA), "blocks")
    answers = blocks.mapInArrow(tidy(_sample(bits)), PART_SCHEMA).groupBy("bucket").applyInArrow(_rank, PART_SCHEMA)
    dealt = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(tidy_cogroup(_deal(bits)), PART_SCHEMA)
    # what needs no bucket any more travels under a bucket of its own block
    own = F.when(F.col("bucket") < 0, -1 - F.pmod(F.xxhash64("block"), F.lit(1 << bits))).otherwise(F.col("bucket"))
    dealt = dealt.withColumn("bucket", own.cast("int"))
    marks = dealt.groupBy("bucket").applyInArrow(tidy_group(_sort_bucket), PART_SCHEMA)
    schema = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    schema += ", kept binary" if with_text else ""
    cut = blocks.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(tidy_cogroup(_cut(with_text)), schema)
    return cut.withColumnRenamed("id", id_col)
