"""Word vectors against a dense version in NumPy."""

from collections import Counter

import numpy as np
import pytest

from lineseek.operators.query import nearest_words
from lineseek.operators.word_space import association, both_ways, cooccurrences, embed_by_words, random_signs, word_space
from pyspark.sql import functions as F

TEXTS = [
    "cat sat mat cat dog", "dog ran park cat sat", "stock rose market fell stock", "market stock bond fell rose", "rare",
    "cat cat cat", None, "", "dog park ran bond rare cat sat mat", "market rose bond stock park",
]


def table(spark, texts=TEXTS):
    rows = [(i, text if text is None else text.split(), "x") for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "id int, words array<string>, vector string").repartition(3)


def counted(window, least):
    pairs, single = Counter(), Counter()
    for text in TEXTS:
        words = (text or "").split()
        single.update(words)
        for i, word in enumerate(words):
            for j in range(max(0, i - window), min(len(words), i + window + 1)):
                if i != j:
                    pairs[word, words[j]] += 1
    return {(a, b): n for (a, b), n in pairs.items() if single[a] >= least and single[b] >= least}


@pytest.mark.parametrize(("window", "least"), [(1, 1), (3, 3), (50, 2)])
def test_counts(spark, window, least):
    got = both_ways(cooccurrences(table(spark), "words", window, least), "count").collect()
    assert {(r.word, r.context): r["count"] for r in got} == counted(window, least)
    assert len(got) == len(counted(window, least))


def dense(spark, window, least):
    counts = counted(window, least)
    sums = Counter()
    for (a, _), n in counts.items():
        sums[a] += n
    total = sum(sums.values())
    weights = {pair: np.log(n * total / (sums[pair[0]] * sums[pair[1]])) for pair, n in counts.items()}
    weights = {pair: w for pair, w in weights.items() if w > 1e-12}
    words = sorted({a for a, _ in weights})
    matrix = np.zeros((len(words), len(words)))
    for (a, b), w in weights.items():
        matrix[words.index(a), words.index(b)] = w
    return words, matrix


def test_vectors_span_what_dense_iteration_spans(spark):
    words, matrix = dense(spark, 2, 2)
    dim = 4
    asked = spark.createDataFrame([(w,) for w in words], "word string")
    signs = {r.word: r.signs for r in asked.select("word", random_signs(F.col("word"), dim).alias("signs")).collect()}
    basis = np.array([signs[w] for w in words])
    for _ in range(2):
        basis, upper = np.linalg.qr(matrix @ basis)
        basis = basis * np.sign(np.diag(upper))
    want = matrix @ basis
    found = {r.word: r.vector for r in word_space(table(spark), "words", dim=dim, window=2, min_count=2).collect()}
    assert sorted(found) == words
    assert np.array([found[w] for w in words]) == pytest.approx(want, abs=1e-5)


def test_more_dimensions_than_words(spark):
    """Columns that depend on those before are 0, and cosines are those of the whole matrix."""
    words, matrix = dense(spark, 2, 2)
    found = {r.word: r.vector for r in word_space(table(spark), "words", dim=40, window=2, min_count=2).collect()}
    got = np.array([found[w] for w in words])
    assert got @ got.T == pytest.approx(matrix @ matrix.T, abs=1e-4)


def test_mean_of_words_and_no_rows(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0])], "word string, vector array<float>")
    texts = spark.createDataFrame([(1, "a a b"), (2, "unknown"), (3, None), (4, "b")], "id int, text string")
    got = {r.id: r.vec for r in embed_by_words(vectors, texts, dim=2).collect()}
    assert got == {1: pytest.approx([2 / 3, 2 / 3]), 2: [0, 0], 3: [0, 0], 4: [0, 2]}
    assert word_space(table(spark).limit(0), "words", dim=4).collect() == []
    assert association(cooccurrences(table(spark), "words", 2, 1000)).collect() == []


def test_words_of_one_topic_are_near(spark):
    space = word_space(table(spark), "words", dim=8, window=3, min_count=2)
    asked = spark.createDataFrame([("stock",), ("absent",)], "token string")
    near = nearest_words(asked, space, 2, decimals=6).collect()
    assert [r.rank for r in near] == [1, 2] and {r.token for r in near} == {"stock"}
    assert {r.word for r in near} <= {"market", "bond", "fell", "rose"}
