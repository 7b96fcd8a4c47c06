"""Language identification: the vectorised passes against plain recursion, and held-out accuracy."""

import zlib

import numpy as np
import pytest

from lineseek.llm.language import (
    UNKNOWN, LanguageModel, PieceTable, by_length, default_pieces, expected_counts, fit, forward, identify_held_out,
    keep_identified, predict,
)

SCHEMA = "doc_id bigint, text string, lang string, word string, n int, score string"
PIECES = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "bab"]


def segmentations(word):
    if not word:
        yield []
    for size in range(1, len(word) + 1):
        if word[:size] in PIECES or size == 1:
            for rest in segmentations(word[size:]):
                yield [word[:size], *rest]


def chance(word, p):
    return sum(np.prod([p[PIECES.index(x) + 1] if x in PIECES else UNKNOWN for x in s]) for s in segmentations("▁" + word))


@pytest.fixture
def probabilities(rng):
    p = np.array([0.0] + [rng.random() for _ in PIECES])
    return p / p.sum()


def test_forward_sums_all_segmentations(probabilities):
    table, words = PieceTable(PIECES), ["ab", "abab", "b", "cab", "babbab", "aa"]
    model = LanguageModel(PIECES, ["x"], probabilities[:, None])
    got = model.word_scores(table, words)[:, 0]
    assert np.allclose(got, [np.log(chance(word, probabilities)) for word in words])


def test_expected_counts(probabilities):
    table, words = PieceTable(PIECES), ["abab", "baba"]
    (_, letters), = by_length(words)
    got = expected_counts(table.spans(letters), probabilities, np.array([2.0, 1.0]))
    want = np.zeros(len(PIECES) + 1)
    for word, weight in zip(words, (2.0, 1.0)):
        for s in segmentations("▁" + word):
            if all(x in PIECES for x in s):
                part = np.prod([probabilities[PIECES.index(x) + 1] for x in s]) / chance(word, probabilities)
                for x in s:
                    want[PIECES.index(x) + 1] += weight * part
    assert np.allclose(got, want)
    assert forward(table.spans(letters), probabilities[:, None]).shape == (2, 6, 1)


def test_pieces_are_found():
    pieces = default_pieces()
    table = PieceTable(pieces)
    for piece in pieces[:: len(pieces) // 300]:
        letters = np.array([[ord(c) for c in piece]], np.uint32)
        assert table.spans(letters)[-1][0, 0] == pieces.index(piece) + 1


def test_held_out_accuracy(spark, data):
    documents = spark.read.parquet(f"{data}/documents.parquet")
    got = identify_held_out(documents).join(documents, "doc_id").collect()
    assert len(got) == documents.count()
    for row in got:
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 5 == 0) and 0 <= row.score <= 1
    held = [row for row in got if row.held_out]
    assert sum(row.lang_pred == row.lang for row in held) >= 0.97 * len(held)


def brute_fit(texts, table_size, rounds=4):
    """Expectation maximisation over listed segmentations, with the same start and smoothing."""
    words = [word for text in texts for word in text.split()]
    p = np.full(table_size, 1.0 / (table_size - 1))
    for _ in range(rounds):
        counts = np.full(table_size, 0.05)
        for word in words:
            whole = chance(word, p)
            for s in segmentations("▁" + word):
                part = np.prod([p[PIECES.index(x) + 1] if x in PIECES else UNKNOWN for x in s]) / whole
                for x in s:
                    if x in PIECES:
                        counts[PIECES.index(x) + 1] += part
        counts[0] = 0.0
        p = counts / counts.sum()
    return p


def test_whole_prediction_against_brute_force(spark, rng):
    """Model, language and posterior, from all words of the sample, however many."""
    def made(letters, n):
        return " ".join("".join(rng.choices(letters, k=rng.randint(1, 5))) for _ in range(n))

    texts = {"x": [made("aab", 30) for _ in range(4)], "y": [made("abbb", 30) for _ in range(4)]}
    rows = [(i, text, lang) for i, (lang, text) in enumerate((l, t) for l in texts for t in texts[l])]
    model = fit(spark.createDataFrame(rows, "id bigint, text string, lang string"), pieces=PIECES)
    want = {lang: brute_fit(texts[lang], len(PIECES) + 1) for lang in texts}
    assert model.languages == ["x", "y"]
    assert np.allclose(model.probabilities, np.array([want["x"], want["y"]]).T)

    asked = [(i, made("ab", rng.randint(1, 4))) for i in range(60)] + [(60, "c"), (61, "a c b"), (62, "a"), (62, "a")]
    got = predict(spark.createDataFrame(asked, "doc_id bigint, text string"), model).collect()
    assert len(got) == len(asked)
    for row in got:
        words = dict(asked)[row.doc_id].split()
        x, y = (np.prod([chance(word, want[lang]) for word in words]) for lang in ("x", "y"))
        assert row.lang_pred == ("x" if x >= y else "y") and row.score == pytest.approx(max(x, y) / (x + y))


def test_ties_go_to_the_first_language(spark):
    rows = [(i, "the and of", lang) for i, lang in enumerate(["b", "a"] * 3)]
    model = fit(spark.createDataFrame(rows, "id bigint, text string, lang string"))
    got = predict(spark.createDataFrame([(1, "the of"), (2, "日")], "doc_id bigint, text string"), model).collect()
    assert [(row.lang_pred, row.score) for row in got] == [("a", pytest.approx(0.5))] * 2


EDGE = [(1, None), (2, ""), (3, "123 .,!"), (4, "the and of " * 20_000), (5, "und die der " * 5), (5, "und die der " * 5),
        (None, "the and"), (6, "日本語"), (7, "e" * 5000)]


def trained(spark):
    rows = [(i, text, lang) for i, (text, lang) in enumerate([("the and of that with", "en"), ("und die der mit auf", "de")] * 6)]
    return fit(spark.createDataFrame(rows, "id bigint, text string, lang string"))


def test_edges(spark):
    model = trained(spark)
    df = spark.createDataFrame([(*row, None, "w", 1, "s") for row in EDGE], SCHEMA)
    got = [(row.doc_id, row.lang_pred, row.score) for row in predict(df, model).collect()]
    assert len(got) == len(EDGE)
    named = {doc_id: (lang, score) for doc_id, lang, score in got}
    assert all(named[i] == ("und", 0.0) for i in (1, 2, 3))
    assert named[4][0] == "en" and named[5][0] == "de" and named[None][0] == "en"
    assert named[6][1] == pytest.approx(0.5, abs=0.2) and named[7][0] in ("de", "en")
    kept = keep_identified(df, model, least_score=0.9)
    assert kept.columns == df.columns and {row.doc_id for row in kept.collect()} >= {4, 5, None}
    assert {row.doc_id for row in kept.collect()}.isdisjoint({1, 2, 3})


def test_nothing_labelled_and_no_rows(spark):
    df = spark.createDataFrame([(1, "text", None, "w", 1, "s")], SCHEMA)
    assert [tuple(row) for row in identify_held_out(df).collect()] == [(1, False, "und", 0.0)]
    assert identify_held_out(df.limit(0)).collect() == []
