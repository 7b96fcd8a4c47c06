"""Word pairs in tiles: however small these are, nothing is lost, and a pair is no row."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineseek.operators import word_space as ws
from lineseek.operators.portions import packed, unpacked, word_portions


def texts(spark, rows=60):
    draw = random.Random(3)
    words = [f"w{min(int(draw.paretovariate(0.7)), 40)}" for _ in range(rows * 12)]
    lists = [(i % 7 or None, words[12 * i : 12 * i + 12]) for i in range(rows)] + [(None, None), (1, [])]
    return spark.createDataFrame(lists, "key int, words array<string>").repartition(3)


def plain(df, window, least):
    lists = [r.words or [] for r in df.collect()]
    every = [w for words in lists for w in words]
    known = {w for w in every if every.count(w) >= least}
    found = {}
    for words in lists:
        for i, a in enumerate(words):
            for b in words[i + 1 : i + 1 + window]:
                if {a, b} <= known:
                    pair = min(a, b), max(a, b)
                    found[pair] = found.get(pair, 0) + (2 if a == b else 1)
    return found


def test_numbers_are_packed_and_read_back():
    for numbers in ([], [0], [0, 1, 2**40, 7]):
        assert unpacked(packed(np.array(numbers, np.int64)), len(numbers)).tolist() == numbers


@pytest.mark.parametrize("tile_pairs", [20, 1 << 21])
def test_a_tile_is_a_row_and_no_pair_is_lost(spark, monkeypatch, tile_pairs):
    monkeypatch.setattr(ws, "TILE_PAIRS", tile_pairs)
    df = texts(spark)
    want = plain(df, 3, 3)
    got = {(r.left, r.right): r["count"] for r in ws.cooccurrences(df, "words", 3, 3).collect()}
    assert got == want
    portions = word_portions(df, "key", "words")
    tiles = ws._Tiles(portions, ws._numbered(portions, 3), 3)
    assert tiles.rows.count() <= tiles.across * (tiles.across + 1) // 2
    assert (tiles.across > 3) == (tile_pairs == 20)
    assert tiles.rows.count() < len(want)


def test_vectors_do_not_depend_on_tiles(spark, monkeypatch):
    df = texts(spark)
    want = {r.word: r.vector for r in ws.word_space(df, "words", dim=3, window=2, min_count=2).collect()}
    monkeypatch.setattr(ws, "TILE_PAIRS", 20)
    got = {r.word: r.vector for r in ws.word_space(df, "words", dim=3, window=2, min_count=2).collect()}
    assert got.keys() == want.keys() and len(got) > 5
    for word, vector in want.items():
        assert got[word] == pytest.approx(vector, abs=1e-5)


def test_repeated_and_null_keys_of_texts(spark):
    """Rows of one key share the mean of all their words, a null key has zeros; a word listed twice counts twice."""
    vectors = spark.createDataFrame(
        [("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("b", [0.0, 4.0])], "word string, vector array<float>"
    )
    rows = [(1, "a a b"), (1, "b"), (None, "a"), (2, "a c"), (3, None)]
    got = ws.embed_by_words(vectors, spark.createDataFrame(rows, "id int, text string"), dim=2)
    got = sorted(((r.id or 0, r.vec) for r in got.select("id", F.col("vec")).collect()), key=str)
    want = [(0, [0, 0]), (1, [2 / 6, 12 / 6]), (1, [2 / 6, 12 / 6]), (2, [1, 0]), (3, [0, 0])]
    assert [(k, pytest.approx(v)) for k, v in want] == got
