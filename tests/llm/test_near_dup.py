"""Near-duplicates and components against brute force."""

import re

import numpy as np
import pyarrow as pa
import pytest

from lineseek.llm import components, near_dup
from lineseek.llm.components import connected_components
from lineseek.llm.near_dup import BINS, drop_near_duplicates, near_duplicates, shingle_sets, signatures

SCHEMA = "doc_id bigint, text string, node int, root string, set_key string, n int"


def lowered(text):
    return re.sub("[A-Z]", lambda match: match[0].lower(), text)


def shingles(text, size):
    found = re.findall("[^\x20\x09-\x0d]+", lowered(text or ""))
    if len(found) < size:
        return frozenset([tuple(found)] if found else [])
    return frozenset(tuple(found[i : i + size]) for i in range(len(found) - size + 1))


def roots(nodes, pairs):
    parent = {node: node for node in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    return {node: find(node) for node in nodes}


def brute(rows, size, percent=80):
    sets = {doc_id: shingles(text, size) for doc_id, text in rows if doc_id is not None}
    ids = sorted(sets)
    pairs = []
    for i, a in enumerate(ids):
        for b in ids[:i]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                pairs.append((a, b))
    return sets, roots(ids, pairs)


def corpus(words, rng):
    rows = [(None, "no id here at all"), (1, None), (2, ""), (3, " \n\t "), (4, "Two words"), (5, "two WORDS"), (6, "two  words")]
    doc_id = 10
    for size in (5, 12, 40, 150):
        for _ in range(4):
            base = words(size)
            for _ in range(7):
                copy = list(base)
                for _ in range(rng.randrange(0, max(2, size // 18))):
                    copy[rng.randrange(size)] = "changed%d" % rng.randrange(3)
                rows.append((doc_id, " ".join(copy)))
                doc_id += 1
    passage = words(80)
    for _ in range(25):
        rows.append((doc_id, " ".join(words(rng.randint(2, 25)) + passage + words(rng.randint(2, 25)))))
        doc_id += 1
    return rows


@pytest.mark.parametrize(("size", "chunk"), [(4, 2000), (5, 2000), (4, 6)])
def test_against_brute_force(spark, words, rng, monkeypatch, size, chunk):
    """A small chunk size sends large components through pivots and visits."""
    monkeypatch.setattr(near_dup, "CHUNK_DOCUMENTS", chunk)
    monkeypatch.setattr(near_dup, "PIVOTS", 2)
    rows = corpus(words, rng)
    df = spark.createDataFrame([(*row, 1, "r", "s", 3) for row in rows], SCHEMA).repartition(3)
    sets, want = brute(rows, size)
    got = near_duplicates(df, words=size).collect()
    assert len(got) == len(rows)
    for row in got:
        if row.doc_id is None:
            assert (row.component_id, row.kept) == (None, True)
        else:
            assert (row.n_shingles, row.component_id) == (len(sets[row.doc_id]), want[row.doc_id]), row
            assert row.kept == (row.doc_id == row.component_id)


def test_rows_dropped_keep_their_columns(spark):
    text = "one two three four five six seven"
    df = spark.createDataFrame([(3, text, 1, "r", "s", 3), (2, text.upper(), 2, "r", "s", 3), (9, None, 1, "", "", 1)], SCHEMA)
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(row.doc_id for row in kept.collect()) == [2, 9]


def test_repeated_rows_and_one_id_at_two_texts(spark):
    long_text, other = "a b c d e f g h", "p q r s t u v w"
    rows = [(1, long_text), (1, long_text), (1, other), (2, other), (3, long_text)]
    df = spark.createDataFrame([(*row, 1, "r", "s", 3) for row in rows], SCHEMA)
    got = {(row.doc_id, row.component_id) for row in near_duplicates(df).collect()}
    assert got == {(1, 1), (2, 1), (3, 1)}


def test_no_rows(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_signatures_estimate_similarity(words, rng):
    base = words(400)
    other = base[:360] + words(40)
    sets = shingle_sets(pa.array([" ".join(base), " ".join(other)]), 4)
    truth = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
    one, two = signatures(sets)
    assert abs((one == two).mean() - truth) < 4 * (truth * (1 - truth) / BINS) ** 0.5


@pytest.mark.parametrize("per_task", [500_000, 25])
def test_components(spark, rng, monkeypatch, per_task):
    monkeypatch.setattr(components, "EDGES_PER_TASK", per_task)
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(5, 5), (200, 201), (201, 200)]
    pairs += [(rng.randrange(300, 360), rng.randrange(300, 360)) for _ in range(40)]
    got = connected_components(spark.createDataFrame(pairs, "a bigint, b bigint").repartition(5)).collect()
    pairs = [pair for pair in pairs if pair[0] != pair[1]]
    want = roots({x for pair in pairs for x in pair}, pairs)
    assert {row.node: row.root for row in got} == want and len(got) == len(want)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
