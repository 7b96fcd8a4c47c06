"""How the sources of a language differ in their words: exact scaled chi-square
divergences between all sources, and the terms that set a source apart.

A term's row is its counts by source, in order of the source, without zeros. Most pairs
of a source and a term have no count, and many terms have equal rows. So a
divergence, a sum over all terms of a language, is taken apart: what it would
be without any count, what each single count changes, and what two counts of one term
change beyond that. The last is summed over a frequent-pattern tree: rows are inserted
with the number of terms that have them, rows with a common beginning share its nodes, and
a correction is worked out once for each node and each of its ancestors, whatever
number of terms passes through. Equal rows are counted before they move; trees grow
over ranges of sorted rows, one to an Arrow batch, and their corrections add up.

Every number is an integer and every sum exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineseek.llm.rolling import utf8
from lineseek.llm.tokens import portions
from lineseek.llm.work import materialise, shuffle_partitions, tidy

SCALE = 1_000_000_000  # fixed value: probabilities are whole numbers of billionths
LEAST_DOCUMENTS, TERMS_TOLD = 3, 200
SLICE_BYTES = 8 << 20
COMBINATIONS = 1 << 20  # node-ancestor combinations worked out at a time
DENSE_PAIRS = 1 << 20

COUNTS = "lang string, source string, term string, n bigint, documents bigint"

_letters = np.full(256, 32, np.uint8)
_letters[128:] = np.arange(128, 256)
_letters[97:123] = np.arange(97, 123)
_letters[65:91] = np.arange(97, 123)


def split_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms in a row (runs of letters A-Z, lower-cased, and of anything beyond ASCII), and where
    each text begins among them. Works on bytes: those of longer code points are all above 127."""
    data, bounds = utf8(texts)
    only = _letters[data] if len(data) else np.zeros(0, np.uint8)
    plain = pa.StringArray.from_buffers(len(texts), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(only))
    lists = pc.ascii_split_whitespace(plain)
    starts = lists.offsets.to_numpy().astype(np.int64)
    words = lists.flatten()
    full = pc.not_equal(pc.binary_length(words), 0)
    upto = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return words.filter(full), upto[starts - starts[0]]


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and each of ``values`` added up by key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values)


@tidy
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents by language, source and term, summed within slices; an
    empty term stands for each group itself."""
    for batch in portions(batches, 2, SLICE_BYTES):
        langs, sources = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
        width = len(sources.dictionary)
        group = langs.indices.to_numpy().astype(np.int64) * width + sources.indices.to_numpy()
        words, bounds = split_terms(batch.column(2))
        coded = words.dictionary_encode()
        size = len(coded.dictionary)
        owner = np.repeat(np.arange(len(batch)), np.diff(bounds))
        within, times = np.unique(owner * size + coded.indices.to_numpy(), return_counts=True)
        document, term = np.divmod(within, max(size, 1))
        key, n, documents = _sums(group[document] * size + term, times, np.ones(len(term), np.int64))
        of, term = np.divmod(key, max(size, 1))
        empty = np.unique(group)
        lang, source = np.divmod(np.concatenate([empty, of]), width)
        nothing = np.zeros(len(empty), np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                langs.dictionary.take(pa.array(lang)),
                sources.dictionary.take(pa.array(source)),
                pa.concat_arrays([pa.array([""] * len(empty), pa.string()), coded.dictionary.take(pa.array(term)).cast(pa.string())]),
                pa.array(np.concatenate([nothing, n])),
                pa.array(np.concatenate([nothing, documents])),
            ],
            ["lang", "source", "term", "n", "documents"],
        )


def term_rows(documents: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """``lang, term, n, items`` of each kept term: ``items`` are its ``(source, n)`` in order of the source.
    The empty term of a language lists all its sources, with no count. One shuffle of summed counts."""
    counted = documents.mapInArrow(_count, COUNTS).repartition("lang", "term")
    by_source = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    rows = by_source.groupBy("lang", "term").agg(
        F.sum("n").alias("n"),
        F.sum("documents").alias("documents"),
        F.sort_array(F.collect_list(F.struct("source", "n"))).alias("items"),
    )
    return rows.where((F.col("documents") >= least_documents) | (F.col("term") == "")).drop("documents")


def group_totals(rows: DataFrame) -> DataFrame:
    """``lang, source, terms, size, lang_size`` of each group: kept terms of the language, and the
    divisors of the group's and the language's probabilities."""
    held = rows.select("lang", F.explode("items").alias("item")).groupBy("lang", F.col("item.source").alias("source")).agg(
        F.sum("item.n").alias("held")
    )
    langs = rows.groupBy("lang").agg(
        F.sum(F.when(F.col("term") != "", 1).otherwise(0)).alias("terms"), F.sum("n").alias("lang_held")
    )
    return held.join(langs, "lang").select(
        "lang", "source", "terms", (F.col("held") + F.col("terms")).alias("size"),
        (F.col("lang_held") + F.col("terms")).alias("lang_size"),
    )


def whole_division(left: Column, right: Column) -> Column:
    return F.call_function("div", left, right)


def scaled(count: Column, size: Column) -> Column:
    """``1 + floor(SCALE * (count + 1) / size)``; the product may exceed 64 bits."""
    wide = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return whole_division(wide, size) + 1


def contribution(p: Column, q: Column) -> Column:
    return whole_division((p - q) * (p - q), q)


def scaled_array(count: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The same for arrays: long division in three steps of a thousand, exact up to sizes of 9e15."""
    left, out = count + 1, np.zeros(len(count), np.int64)
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // size
        left = left % size
    return out + 1


def _nodes(items: np.ndarray, lang: np.ndarray, starts: np.ndarray, times: np.ndarray):
    """The tree of sorted rows: ``(row, depth, times)`` of each node, ``row`` the first that passes through it.

    ``items`` holds the codes of all rows' items in a row, from ``starts`` to ``starts``.
    """
    lengths = np.diff(starts)
    row = np.repeat(np.arange(len(lengths)), lengths)
    depth = np.arange(len(items)) - starts[row]
    before = np.maximum(row - 1, 0)
    same = (row > 0) & (lang[row] == lang[before]) & (depth < lengths[before])
    same &= items == items[np.where(same, starts[before] + depth, 0)]
    shared = np.minimum.reduceat(np.where(same, lengths[row], depth), starts[:-1])
    rows, depths, weights = [], [], []
    for d in range(int(lengths.max())):
        through = np.flatnonzero(lengths > d)
        opens = np.flatnonzero(shared[through] <= d)
        rows.append(through[opens])
        depths.append(np.full(len(opens), d))
        weights.append(np.add.reduceat(times[through], opens))
    return np.concatenate(rows), np.concatenate(depths), np.concatenate(weights)


@tidy
def _correct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corrections of pairs of sources, from the tree of each batch of sorted rows."""
    for batch in batches:
        if not len(batch):
            continue
        langs, paths = batch.column(0).dictionary_encode(), batch.column(1)
        starts = paths.offsets.to_numpy().astype(np.int64)
        starts = starts - starts[0]
        flat = paths.flatten()
        sources = flat.field("source").dictionary_encode()
        source = sources.indices.to_numpy().astype(np.int64)
        n, size = (flat.field(name).to_numpy() for name in ("n", "size"))
        lang = langs.indices.to_numpy().astype(np.int64)
        codes = np.unique(np.stack([source, n]), axis=1, return_inverse=True)[1].ravel()
        row, depth, times = _nodes(codes, lang, starts, batch.column(2).to_numpy())
        p, absent = scaled_array(n, size), scaled_array(np.zeros(len(n), np.int64), size)
        width = len(sources.dictionary)
        keys, values = [], []
        upto = np.concatenate([[0], np.cumsum(depth)])
        cuts = np.unique(np.searchsorted(upto, np.arange(0, int(upto[-1]) + COMBINATIONS, COMBINATIONS)).clip(0, len(depth)))
        for first, last in zip(cuts, np.append(cuts[1:], len(depth)), strict=True):
            count = depth[first:last]
            node = np.repeat(np.arange(first, last), count)
            if not len(node):
                continue
            above = starts[row[node]] + np.arange(len(node)) - np.repeat(upto[first:last] - upto[first], count)
            own = starts[row[node]] + depth[node]
            for one, other in ((above, own), (own, above)):
                change = _part(p[one], p[other]) - _part(p[one], absent[other])
                change += _part(absent[one], absent[other]) - _part(absent[one], p[other])
                key, value = _summed((lang[row[node]] * width + source[one]) * width + source[other], change * times[node])
                keys.append(key)
                values.append(value)
        if not keys:
            continue
        key, value = _sums(np.concatenate(keys), np.concatenate(values))
        key, other = np.divmod(key, width)
        of, one = np.divmod(key, width)
        yield pa.RecordBatch.from_arrays(
            [langs.dictionary.take(pa.array(of)), sources.dictionary.take(pa.array(one)),
             sources.dictionary.take(pa.array(other)), pa.array(value)],
            ["lang", "source", "item", "value"],
        )


def _part(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _summed(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = int(key.max()) + 1
    if width > DENSE_PAIRS:
        return _sums(key, value)
    total, seen = np.zeros(width, np.int64), np.zeros(width, bool)
    np.add.at(total, key, value)
    seen[key] = True
    return np.flatnonzero(seen), total[seen]


def pair_values(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value``: the divergence of each source from each other one of its language.

    ``counts`` holds ``lang, term, source, n, size``.
    """
    paths = counts.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "n", "size"))).alias("path"))
    paths = materialise(paths.groupBy("lang", "path").agg(F.count("*").alias("times")), "paths")
    parts = shuffle_partitions(counts.sparkSession)
    sorted_ = paths.repartitionByRange(parts, "lang", "path").sortWithinPartitions("lang", "path")
    both = sorted_.mapInArrow(_correct, "lang string, source string, item string, value bigint")
    absent = scaled(F.lit(0), F.col("size"))
    known = groups.where("terms > 0").select("lang", "source", "terms", absent.alias("absent"))
    other = known.select("lang", F.col("source").alias("item"), F.col("absent").alias("other_absent"))
    apart = F.col("source") != F.col("item")
    none = known.join(other, "lang").where(apart).select(
        "lang", "source", "item",
        (F.col("terms") * contribution(F.col("absent"), F.col("other_absent"))).alias("value"),
    )
    single = counts.groupBy("lang", "source", "n", "size").agg(F.count("*").alias("times")).select(
        "lang", "source", "times", scaled(F.col("n"), F.col("size")).alias("p"), absent.alias("absent")
    )
    single = single.join(other, "lang").where(apart)
    there = F.col("times") * (contribution(F.col("p"), F.col("other_absent")) - contribution(F.col("absent"), F.col("other_absent")))
    back = F.col("times") * (contribution(F.col("other_absent"), F.col("p")) - contribution(F.col("other_absent"), F.col("absent")))
    directed = single.select(
        "lang",
        F.explode(F.array(
            F.struct(F.col("source"), F.col("item"), there.alias("value")),
            F.struct(F.col("item").alias("source"), F.col("source").alias("item"), back.alias("value")),
        )).alias("r"),
    ).select("lang", "r.*")
    listed = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where(apart)
    every = listed.withColumn("value", F.lit(0).cast("bigint")).unionByName(none).unionByName(directed).unionByName(both)
    total = F.sum(F.col("value").cast("decimal(38,0)")).cast("bigint")
    return every.groupBy("lang", "source", "item").agg(total.alias("value"))


def telling_terms(counts: DataFrame) -> DataFrame:
    """``lang, source, item, value`` of terms more probable in the group than in the language."""
    p, q = scaled(F.col("n"), F.col("size")), scaled(F.col("lang_n"), F.col("lang_size"))
    judged = counts.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    return judged.select("lang", "source", "item", contribution(F.col("p"), F.col("q")).alias("value"))


def source_divergence(
    documents: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    least_documents: int = LEAST_DOCUMENTS,
    terms_told: int = TERMS_TOLD,
) -> DataFrame:
    """``lang, source, part, item, value, rank`` of every group (language and source) of the rows.

    Part ``pair`` ranks the other sources of the language by their divergence from the
    group, part ``term`` the terms (``terms_told`` at most) that set the group
    apart from its language; ranks go by falling value, then by the item's UTF-8.
    Terms count if ``least_documents`` rows of the language hold them. Null text,
    language and source are empty ones; a group without terms has the
    probabilities of no counts, and a language without kept terms has pairs
    of value 0. Repeated rows count each time; ids and other columns don't
    matter. An empty table gives no rows. A text is one task's work; groups meet
    on the terms' and rows' keys only, and the largest may hold any share.
    """
    texts = documents.select(
        F.coalesce(F.col(lang_col), F.lit("")).alias("lang"),
        F.coalesce(F.col(source_col), F.lit("")).alias("source"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    rows = materialise(term_rows(texts, least_documents), "terms")
    groups = materialise(group_totals(rows), "groups")
    kept = rows.where(F.col("term") != "").select("lang", "term", F.col("n").alias("lang_n"), F.explode("items").alias("item"))
    counts = kept.select("lang", "term", "lang_n", "item.*").join(groups.drop("terms"), ["lang", "source"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = pair_values(counts, groups).withColumn("rank", F.row_number().over(order))
    terms = telling_terms(counts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= terms_told)
    parts = [
        part.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
        for name, part in (("pair", pairs), ("term", terms))
    ]
    return parts[0].unionByName(parts[1])
