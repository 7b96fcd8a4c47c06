"""Skip-gram training against plain versions of its steps; nothing in it grows with the vocabulary in the driver."""

import heapq
import math

import numpy as np
import pytest

from lineseek.operators import word_training as wt
from lineseek.operators.query import nearest_words
from lineseek.operators.vectors import WordModel, embed_texts, train_word_vectors, word_vectors


@pytest.mark.parametrize("held", [[1], [2], [1, 1], [7, 1, 3, 1], [5, 4, 1, 1, 1], [1000, 300, 50, 7, 1]])
def test_paths_are_those_of_a_shortest_code(held):
    counts = [5 + 3 * i * i for i in range(len(held))]
    tree = wt.Tree(counts, held)
    each = np.repeat(counts, held)
    nodes, sides, starts = tree.paths(np.arange(len(each)))
    assert tree.ids == 2 * len(each) - 1
    heap, least = each.tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        least += both
        heapq.heappush(heap, both)
    assert (np.diff(starts) * each).sum() == least
    paths = [tuple(zip(nodes[a:b][::-1], sides[a:b][::-1], strict=True)) for a, b in zip(starts, starts[1:], strict=False)]
    assert len(set(paths)) == len(paths)
    assert {node for path in paths for node, _ in path} == set(range(tree.leaves, tree.ids))
    assert tree.above(np.arange(len(each))).tolist() == list(range(tree.leaves, tree.ids))
    assert set(tree.above(np.array([0])).tolist()) == {node for node, _ in paths[0]}
    children = {step for path in paths for step in path}
    assert len(children) == 2 * (len(each) - 1)  # each node has one child on either side


def test_contexts():
    rng = np.random.default_rng(1)
    text, lengths = rng.integers(0, 6, 60), [1, 20, 9, 30]
    last = np.repeat(np.cumsum(lengths), lengths)
    first = last - np.repeat(lengths, lengths)
    for part in (slice(0, 60), slice(7, 33), slice(59, 60)):
        half = rng.integers(1, wt.WINDOW + 1, part.stop - part.start)
        near, starts, twice = wt.contexts(text, first, last, part, half)
        for i, place in enumerate(range(part.start, part.stop)):
            want = [text[j] for j in range(first[place], last[place]) if 0 < abs(j - place) <= half[i]]
            got = near[starts[i] : starts[i + 1]].tolist()
            assert got == want
            assert twice[i] or len(set(got)) == len(got)


def test_step_is_the_gradient():
    """Of the log of the chance that each word's path is told from each word near it, repeated words included."""
    rng = np.random.default_rng(2)
    words, nodes = rng.normal(size=(5, 4)).astype(np.float32), rng.normal(size=(6, 4)).astype(np.float32)
    near, starts, path_starts = np.array([1, 2, 1]), np.array([0, 3, 3]), np.array([0, 3, 5])
    path, sides = np.array([0, 2, 5, 1, 5]), np.array([1, -1, 1, 1, -1], np.float32)
    got_words, got_nodes = words.copy(), nodes / 2
    wt.train_step(
        np.array([0, 1]), near, starts, np.array([True, False]), path_starts, path, sides, got_words, got_nodes, 0.1
    )
    want_words, want_nodes = words.astype(float), nodes.astype(float)
    for word in near:
        for node, side in zip(path[:3], sides[:3], strict=True):
            share = 0.1 * ((side + 1) / 2 - 1 / (1 + math.exp(-float(words[word] @ nodes[node]))))
            want_words[word] += share * nodes[node]
            want_nodes[node] += share * words[word]
    assert got_words == pytest.approx(want_words, abs=1e-5)
    assert 2 * got_nodes == pytest.approx(want_nodes, abs=1e-5)


def test_changes_add_up_until_they_settle():
    old = np.array([[1.0, 1.0], [0.0, 0.0], [5.0, 5.0]], np.float32)
    state = wt.pa.table({"block": [0], "vectors": [old.tobytes()]})
    one = wt._pieces(0, np.array([0, 1]), old[:2] + np.float32(1), np.array([1.0, 1e9]))
    two = wt._pieces(1, np.array([0, 1]), old[:2] + np.float32(3), np.array([1.0, 1e9]))
    made = wt._merge(2, 1000.0)(state, wt.pa.concat_tables([one, two]))
    got = np.frombuffer(made["vectors"][0].as_py(), np.float32).reshape(-1, 2)
    assert got == pytest.approx(np.array([[5, 5], [2, 2], [5, 5]]), abs=0.01)


def topics(spark, words=3000, rows=400):
    """Texts of one of two topics, and words that occur as often in either."""
    draw = np.random.default_rng(4)
    lists = []
    for i in range(rows):
        own = [f"{'ab'[i % 2]}{n}" for n in draw.integers(0, 8, 20)]
        lists.append((i, [w for pair in zip(own, (f"x{n}" for n in draw.integers(0, words, 20)), strict=True) for w in pair]))
    lists += [(rows, None), (rows + 1, []), (rows + 2, [None, "a1"])]
    return spark.createDataFrame(lists, "id int, words array<string>").repartition(9)


def test_no_vocabulary_in_the_driver(spark, monkeypatch):
    """Trained in several rounds; what is collected is a row a count and a row a portion."""
    documents, frame = topics(spark), type(spark.range(1))
    collect, train, collected, rounds = frame.collect, wt._train, [], []

    def counted(self):
        rows = collect(self)
        collected.append(len(rows))
        return rows

    with monkeypatch.context() as patch:
        patch.setattr(wt, "PORTION_WORDS", 1500)
        patch.setattr(frame, "collect", counted)
        patch.setattr(wt, "_train", lambda *options: rounds.append(options) or train(*options))
        model = train_word_vectors(documents, "words", dim=8, min_count=1)
    assert isinstance(model, WordModel) and len(rounds) > 1
    assert rounds[0][-2] == 0 and rounds[-1][-1] == pytest.approx(1)
    assert collected and max(collected) < 150
    vectors = {r.word: r.vector for r in word_vectors(model).collect()}
    assert len(vectors) > 2500 and {"a0", "b7"} < set(vectors)
    assert all(len(v) == 8 and np.isfinite(v).all() for v in vectors.values())


def test_words_of_one_topic_are_near(spark):
    documents = spark.createDataFrame([(r.words,) for r in topics(spark, 40, 1200).collect()], "words array<string>")
    vectors = word_vectors(train_word_vectors(documents, "words", dim=8, min_count=20))
    asked = spark.createDataFrame([("a0",), ("b3",)], "token string")
    near = nearest_words(asked, vectors).collect()
    assert len(near) == 6 and all(r.word[0] == r.token[0] for r in near)


def test_no_word_often_enough(spark):
    documents = spark.createDataFrame([(["a", "b"],), (None,)], "words array<string>")
    with pytest.raises(ValueError, match="5 times"):
        train_word_vectors(documents, "words")


def test_one_word(spark):
    documents = spark.createDataFrame([(["a", "a"],), (["a"],)], "words array<string>")
    assert [r.word for r in word_vectors(train_word_vectors(documents, "words", dim=3, min_count=1)).collect()] == ["a"]


def test_mean_of_a_text(spark):
    """Unknown words count as zeros; each row has its own mean, whatever its key."""
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0])], "word string, vector array<float>")
    rows = [(1, "a a b"), (1, "b"), (None, "a c"), (2, "c"), (3, ""), (4, None)]
    texts = spark.createDataFrame(rows, "id int, text string")
    got = sorted(((r.id or 0, list(r.vec)) for r in embed_texts(WordModel(vectors, 2), texts).collect()), key=str)
    assert got == [(0, [0.5, 0]), (1, [0, 2]), (1, pytest.approx([2 / 3, 2 / 3])), (2, [0, 0]), (3, [0, 0]), (4, [0, 0])]
