"""Near-duplicates by MinHash: one-permutation hashing, banded buckets, star-shaped candidates.

1. A document's set of word shingles is hashed once. The hash range is cut into
   bins; the least hash of each bin is the signature, and an empty bin takes
   the value of the first filled one in a fixed order of its own (optimal
   densification). Documents with equal sets are one class from here on.
2. Bands of bins are bucket keys. A bucket of m classes gives m - 1 edges, all
   to its least member: enough to know which classes may be linked at all,
   however large the bucket.
3. Each candidate component is brought together once, in chunks of bounded
   size, and its pairs that share a bucket and aren't connected yet are
   confirmed on the full sets. If a component has several chunks, some of its
   members (pivots) are part of every chunk; afterwards all members outside
   its largest group of links visit every chunk, so no pair is left out.
4. Confirmed links give the final components.

With 36 bands of 5 bins, a pair at similarity 0.8 shares no bucket with a
probability of 6e-7, one at 0.85 with 5e-10.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineseek.llm.components import connected_components
from lineseek.llm.rolling import Hashed, mixed, utf8
from lineseek.llm.tokens import slices
from lineseek.llm.work import materialise, tidy, tidy_group

BANDS, BINS_PER_BAND = 36, 5
BINS = BANDS * BINS_PER_BAND
CHUNK_SHINGLES, CHUNK_DOCUMENTS, PIVOTS = 1_500_000, 2000, 8
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)

LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

#: For each bin, the order in which it looks for a filled one.
DONORS = np.stack([np.random.default_rng(bin_).permutation(BINS) for bin_ in range(BINS)])


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of all texts, and where each text's words begin (one bound more)."""
    data, bounds = utf8(texts)
    data = LOWERED[data]
    inside = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[bounds] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return mixed(Hashed(data).ranges(starts, ends)), np.searchsorted(starts, bounds)


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, in order. A text of fewer words has its
    whole sequence as the only one, a text without words none."""
    hashes, bounds = word_hashes(texts)
    factors = np.array([mixed(PLACES[i % 4 : i % 4 + 1] + np.uint64(i))[0] | np.uint64(1) for i in range(words)])
    n = max(0, len(hashes) - words + 1)
    shingles = np.zeros(n, np.uint64)
    for place in range(words):
        shingles += hashes[place : place + n] * factors[place]
    shingles = mixed(shingles)
    sets = []
    for start, end in zip(bounds[:-1], bounds[1:], strict=True):
        if end - start >= words:
            sets.append(np.unique(shingles[start : end - words + 1]))
        elif end > start:
            short = (hashes[start:end] * factors[: end - start]).sum(dtype=np.uint64) + np.uint64(end - start)
            sets.append(mixed(np.array([short])))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Least hash per bin, empty bins filled: (sets, BINS). No set is empty."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    owner, hashes = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    bins = (((hashes >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)).astype(np.int64)
    cell = owner * BINS + bins  # ascending, as the hashes of a set are
    lead = np.flatnonzero(np.diff(cell, prepend=-1))
    out = np.zeros(len(sets) * BINS, np.uint64)
    filled = np.zeros(len(sets) * BINS, bool)
    out[cell[lead]], filled[cell[lead]] = hashes[lead], True
    out, filled = out.reshape(-1, BINS), filled.reshape(-1, BINS)
    for rows in np.array_split(np.arange(len(sets)), -(-len(sets) // 2048)):
        row, empty = np.nonzero(~filled[rows])
        row = rows[row]
        for attempt in range(BINS):
            if not len(row):
                break
            donor = DONORS[empty, attempt]
            found = filled[row, donor]
            out[row[found], empty[found]] = out[row[found], donor[found]]
            row, empty = row[~found], empty[~found]
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """Bucket keys: (sets, BANDS)."""
    bands = mixed(signature).reshape(len(signature), BANDS, BINS_PER_BAND)
    keys = np.arange(BANDS, dtype=np.uint64)[None, :] * PLACES[1]
    for place in range(BINS_PER_BAND):
        keys = keys * PLACES[0] + bands[:, :, place]
    return mixed(keys)


def set_key(hashes: np.ndarray) -> bytes:
    """128 bits that tell a set from others."""
    return np.array([mixed(hashes).sum(), mixed(hashes * PLACES[2]).sum()], np.uint64).tobytes()


def _describe(words: int):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for texts in slices(batch.column(1).fill_null(""), 2 << 20):
                sets = shingle_sets(texts, words)
                held = [place for place, hashes in enumerate(sets) if len(hashes)]
                keys = np.zeros((0, BANDS), np.uint64)
                if held:
                    keys = band_keys(signatures([sets[place] for place in held]))
                counts = np.zeros(len(sets) + 1, np.int32)
                counts[1:][held] = BANDS
                buckets = pa.ListArray.from_arrays(
                    pa.array(np.cumsum(counts, dtype=np.int32)), pa.array(keys.view(np.int64).ravel())
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(done, len(texts)),
                        pa.array([len(hashes) for hashes in sets], pa.int64()),
                        pa.array([set_key(hashes) for hashes in sets], pa.binary()),
                        buckets,
                    ],
                    ["id", "n", "set_key", "buckets"],
                )
                done += len(texts)

    return describe


def similar(one: int, other: np.ndarray, shared: np.ndarray, percent: int) -> np.ndarray:
    return 100 * shared >= percent * (one + other - shared)


def linked_groups(
    sets: list[np.ndarray], percent: int, groups: np.ndarray | None = None, asking: np.ndarray | None = None
) -> np.ndarray:
    """A group number for each set: those in one group of ``groups`` before, and
    all that similar pairs connect. Only pairs that share a bucket and aren't in
    one group yet are compared; with ``asking``, one of a pair must be among these."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    hashes = np.concatenate([sets[place] for place in order])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    buckets = band_keys(signatures([sets[place] for place in order]))
    label = (np.arange(len(sets)) if groups is None else np.unique(groups, return_inverse=True)[1])[order].copy()
    asks = np.ones(len(sets), bool) if asking is None else asking[order]
    for x in range(len(sets)):
        most = np.searchsorted(sizes, sizes[x] * 100 // percent, side="right")
        near = np.arange(x + 1, most)
        near = near[(label[near] != label[x]) & (asks[near] | asks[x])]
        near = near[(buckets[near] == buckets[x]).any(axis=1)]
        if not len(near):
            continue
        mine = hashes[bounds[x] : bounds[x + 1]]
        lengths = sizes[near]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        theirs = hashes[np.repeat(bounds[near] - upto[:-1], lengths) + np.arange(upto[-1])]
        at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
        shared = np.add.reduceat((mine[at] == theirs).astype(np.int64), upto[:-1])
        for y in near[similar(int(sizes[x]), lengths, shared, percent)]:
            if label[y] != label[x]:
                label[label == label[y]] = label[x]
    out = np.empty(len(sets), np.int64)
    out[order] = label
    return out


def _confirm(words: int, percent: int):
    """Links among the rows (node, set_key, text, label, asks) of one chunk: each
    node of a group with the group's least."""

    def confirm(rows: pa.Table) -> pa.Table:
        texts = rows.column("text").combine_chunks()
        texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
        sets = [hashes for part in slices(texts.fill_null(""), 4 << 20) for hashes in shingle_sets(part, words)]
        nodes, labels = rows.column("node").to_numpy(), rows.column("label").to_numpy()
        asks = rows.column("asks").to_numpy()
        seen, places = set(), []
        for place, key in enumerate(rows.column("set_key").to_pylist()):
            # an id may stand at several texts, and a pivot or visitor at home in this chunk arrives twice
            if set_key(sets[place]) == key and nodes[place] not in seen:
                seen.add(nodes[place])
                places.append(place)
        places = np.array(places, np.int64)
        if not len(places):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        mine = nodes[places]
        groups = linked_groups([sets[place] for place in places], percent, labels[places], np.isin(mine, nodes[asks]))
        least = np.full(groups.max() + 1, mine.max())
        np.minimum.at(least, groups, mine)
        linked = least[groups] != mine
        return pa.table({"a": mine[linked], "b": least[groups][linked]})

    return confirm


def _links(classes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) between classes, enough to connect all that are connected."""
    exploded = classes.select("node", F.explode("buckets").alias("bucket"))
    heads = exploded.groupBy("bucket").agg(F.min("node").alias("head"), F.count("*").alias("held")).where("held > 1")
    edges = exploded.join(heads, "bucket").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    candidates = connected_components(edges)

    members = candidates.join(classes.select("node", "n", "low_id", "set_key"), "node")
    sizes = members.groupBy("root").agg(F.sum("n").alias("shingles"), F.count("*").alias("held"))
    chunks = F.greatest(F.ceil(F.col("shingles") / CHUNK_SHINGLES), F.ceil(F.col("held") / CHUNK_DOCUMENTS))
    sizes = sizes.select("root", chunks.cast("int").alias("chunks"))
    members = members.join(sizes, "root").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    # any text of a class will do; it comes by the class' least id and is checked by its set
    members = members.join(texts, members["low_id"] == texts["text_id"]).select(
        "root", "node", "set_key", "chunks", "chunk", "text"
    )
    members = materialise(members, "members")
    rows = ["root", "chunk", "node", "set_key", "text", "label", "asks"]

    # every chunk with its component's pivots
    large = members.where("chunks > 1")
    place = F.row_number().over(Window.partitionBy("root").orderBy(F.xxhash64(F.lit(1), "node"), "node"))
    pivot_nodes = large.select("root", "node").distinct().withColumn("place", place).where(F.col("place") <= PIVOTS)
    pivots = large.join(pivot_nodes.select("node"), "node", "left_semi").withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    )
    first = members.union(pivots.select(members.columns))
    first = first.select("*", F.col("node").alias("label"), F.lit(True).alias("asks")).select(rows)
    confirm = tidy_group(_confirm(words, percent))
    links = materialise(first.groupBy("root", "chunk").applyInArrow(confirm, "a bigint, b bigint"), "links")
    if large.limit(1).count() == 0:
        return links

    # those outside the largest linked group of their component visit every chunk
    linked = connected_components(links).select("node", F.col("root").alias("linked"))
    labelled = large.select("root", "node").distinct().join(linked, "node", "left")
    labelled = materialise(labelled.select("root", "node", F.coalesce("linked", "node").alias("label")), "labels")
    counts = labelled.groupBy("root", "label").count()
    largest = counts.groupBy("root").agg(F.max_by("label", "count").alias("largest"))
    outside = labelled.join(largest, "root").where("label <> largest").select("node")
    large = large.join(labelled.select("node", "label"), "node")
    visitors = large.join(outside, "node", "left_semi")
    visiting = visitors.select("root", F.col("chunk").alias("visit")).distinct()
    home = large.join(visiting, "root").select(*rows[:-1], "visit", F.lit(False).alias("asks"))
    guests = visitors.withColumn("visit", F.col("chunk")).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    )
    guests = guests.select(*rows[:-1], "visit", F.lit(True).alias("asks"))
    more = home.union(guests).groupBy("root", "chunk", "visit").applyInArrow(confirm, "a bigint, b bigint")
    return links.union(materialise(more, "links"))


def near_duplicates(
    documents: DataFrame,
    *,
    words: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id_col, n_shingles, component_id, kept`` for every row.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a
    document's set holds its distinct shingles of ``words`` words, or its whole
    sequence if shorter. Documents are linked when 100 * intersection >=
    ``percent`` * union; ``component_id`` is the smallest id reachable.
    Texts without a word (null, empty, blank) and rows with a null id are linked
    with nothing. Repeated rows are in one component; those that carry its id
    are all kept. Other columns don't matter. An empty table gives no rows.
    """
    texts = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = materialise(
        texts.mapInArrow(tidy(_describe(words)), "id bigint, n bigint, set_key binary, buckets array<bigint>"), "shingles"
    )
    classes = (
        rows.where("n > 0 AND id IS NOT NULL")
        .groupBy("set_key")
        .agg(F.min("id").alias("low_id"), F.any_value("n").alias("n"), F.any_value("buckets").alias("buckets"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    classes = materialise(classes, "classes")
    named = texts.select(F.col("id").alias("text_id"), "text").where("text_id IS NOT NULL")
    connected = connected_components(_links(classes, named, words, percent))
    placed = classes.select("node", "set_key", "low_id").join(connected, "node", "left")
    placed = placed.select("set_key", "low_id", F.coalesce("root", "node").alias("root"))
    lowest = placed.groupBy("root").agg(F.min("low_id").alias("component_id"))
    named_sets = placed.join(lowest, "root").select("set_key", "component_id")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    return rows.select("id", "n", "set_key").join(named_sets, "set_key", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def drop_near_duplicates(documents: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``documents`` whose id names its component, all columns as they were.

    Where one id stands at several texts, all of its rows go if one of them does.
    """
    judged = near_duplicates(documents, id_col=id_col, **options)
    lost = judged.where(~F.col("kept")).select(F.col(id_col).alias("lost_id")).distinct()
    whole = documents.select(F.struct("*").alias("row"))
    return whole.join(lost, F.col(f"row.{id_col}").cast("long") == F.col("lost_id"), "left_anti").select("row.*")
