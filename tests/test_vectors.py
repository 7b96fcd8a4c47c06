import numpy as np
import pytest
from brute import cosine
from checks.compare import neighbour_recall
from pyspark.sql import functions as F

from lineseek.functions.vectors import cosine_similarity
from lineseek.operators import pair_scan
from lineseek.operators.query import expand_similar_words, nearest_words
from lineseek.operators.vectors import (
    attach_vectors,
    embed_texts,
    nearest_approx,
    nearest_exact,
    train_word_vectors,
    word_vectors,
)

PAIRS = [
    ([1.0, 0.0], [1.0, 0.0]), ([1.0, 2.0], [-1.0, -2.0]), ([0.0, 0.0], [1.0, 1.0]), ([], [1.0]),
    ([1.0, 2.0, 3.0], [1.0, 2.0, 3.0, 9.0, 9.0]), ([1.0, 0.0, 5.0], [0.0, 1.0]), (None, [1.0]), ([3.0], [2.0, 7.0]),
]


def test_cosine(spark):
    df = spark.createDataFrame(PAIRS, "a array<float>, b array<float>")
    got = [r[0] for r in df.select(cosine_similarity(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([cosine(a, b) for a, b in PAIRS])


def test_attach_fills_missing_with_zeros(spark):
    docs = spark.createDataFrame([(0,), (1,)], "id bigint")
    vectors = spark.createDataFrame([(1, [1.0, 2.0])], "id bigint, vec array<float>")
    got = {r.id: r.v for r in attach_vectors(docs, vectors, "v", dim=2).collect()}
    assert got == {0: [0.0, 0.0], 1: [1.0, 2.0]}
    assert attach_vectors(docs, None, "v").select(F.size("v")).first()[0] == 384


def table(spark, rows, key, name):
    return spark.createDataFrame(rows, f"{key} bigint, {name} array<float>")


@pytest.mark.parametrize("ragged", [False, True])
@pytest.mark.parametrize("per_scan", [4096, 4])
def test_nearest_exact(spark, monkeypatch, ragged, per_scan):
    monkeypatch.setattr(pair_scan, "QUERIES_PER_SCAN", per_scan)
    monkeypatch.setattr(pair_scan, "CELLS", 64)
    rng = np.random.default_rng(3)

    def vectors(n):
        sizes = rng.integers(0, 9, n) if ragged else [8] * n
        return [(i, [float(x) for x in rng.integers(-3, 4, size)]) for i, size in enumerate(sizes)]

    docs, queries = vectors(80), vectors(9)
    got = {}
    found = nearest_exact(
        table(spark, docs, "id", "vec").repartition(3), table(spark, queries, "query_id", "query_vec"), 5, decimals=6
    )
    for r in found.collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.id, r.similarity)
    for q, v in queries:
        want = sorted((-round(cosine(v, d), 6), i) for i, d in docs)[:5]
        assert [got[q][k + 1][0] for k in range(5)] == [i for _, i in want]
        assert [got[q][k + 1][1] for k in range(5)] == pytest.approx([-s for s, _ in want], abs=2e-6)


def test_nearest_of_no_queries(spark):
    docs = table(spark, [(0, [1.0])], "id", "vec")
    assert nearest_exact(docs, table(spark, [], "query_id", "query_vec"), 5).count() == 0


def test_nearest_approx(spark):
    """Exact scores, no pair twice, most true neighbours found, a hot bucket included."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    near = [centres[i % 12] + rng.normal(scale=0.15, size=16) for i in range(300)]
    same = [centres[0]] * 150  # a third of all documents are copies
    docs = [(i, [float(x) for x in v]) for i, v in enumerate([*near, *same])] + [(450, [0.0] * 16)]
    queries = [(q, [float(x) for x in centres[q] + rng.normal(scale=0.1, size=16)]) for q in range(12)]
    left, right = table(spark, docs, "id", "vec").repartition(4), table(spark, queries, "query_id", "query_vec")
    found = [(r.query_id, r.id, r.similarity) for r in nearest_approx(left, right, 10).collect()]
    exact = {(r.query_id, r.id) for r in nearest_exact(left, right, 10).collect()}
    pairs = {(q, d) for q, d, _ in found}
    assert len(pairs) == len(found)
    for q, d, s in found:
        assert s == pytest.approx(cosine(queries[q][1], docs[d][1]), abs=1e-6)
    others = {(q, d) for q, d in exact if q}  # query 0 ties with 150 copies
    assert len(others & pairs) >= 0.8 * len(others)
    assert min(s for q, _, s in found if q == 0) > 0.9


def test_nearest_approx_of_far_neighbours(spark):
    """Vectors without clusters: the nearest others are at similarities of 0.2 to 0.5."""
    rng = np.random.default_rng(11)
    docs = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(600, 64)))]
    left, right = table(spark, docs, "id", "vec"), table(spark, docs[:40], "query_id", "query_vec")
    exact = nearest_exact(left, right, 10).collect()
    found = {(r.query_id, r.id) for r in nearest_approx(left, right, 10).collect()}
    assert neighbour_recall(exact, found) >= 0.9
    assert neighbour_recall(exact, {(q, d) for q, d in found if q == d}) == 0


def test_word_vectors(spark):
    texts = ["red fox runs", "red wolf runs", "blue whale swims", "blue shark swims"] * 30
    docs = spark.createDataFrame([(i, t, t.split()) for i, t in enumerate(texts)], "id bigint, text string, words array<string>")
    model = train_word_vectors(docs, "words", dim=8, min_count=1)
    vectors = word_vectors(model)
    by_word = {r.word: r.vector for r in vectors.collect()}
    mean = embed_texts(model, docs).where("id = 0").first().vec
    assert mean == pytest.approx(np.mean([by_word[w] for w in texts[0].split()], axis=0).tolist(), abs=1e-5)

    asked = spark.createDataFrame([("fox",), ("unknown",)], "token string")
    near = nearest_words(asked, vectors).collect()
    want = sorted((w for w in by_word if w != "fox"), key=lambda w: -cosine(by_word["fox"], by_word[w]))[:3]
    assert [r.word for r in sorted(near, key=lambda r: r["rank"])] == want
    queries = spark.createDataFrame([(0, "a fox")], "query_id bigint, query string")
    assert {r.expansion for r in expand_similar_words(queries, vectors).collect()} == set(want)


def test_word_vectors_are_stored(spark):
    """No plan over them holds the rows that the driver has."""
    docs = spark.createDataFrame([(["red", "fox", "runs"],)] * 20, "words array<string>")
    vectors = word_vectors(train_word_vectors(docs, "words", dim=4, min_count=1))
    assert "LocalRelation" not in vectors._jdf.queryExecution().optimizedPlan().toString()
    assert {r.word: len(r.vector) for r in vectors.collect()} == {"red": 4, "fox": 4, "runs": 4}
