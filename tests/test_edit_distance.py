"""Edit distances on whole numbers against the plain table."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lineseek.operators.edit_distance import Titles, code_points, distances, pack

rng = random.Random(3)


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def text(longest):
    return "".join(rng.choices("abcé😀 ", k=rng.randint(0, longest)))


def test_distances():
    texts = ["", "a", "é😀"] + [text(70) for _ in range(40)] + [text(700)]
    for query in ["", "a", "zzz", *(text(90) for _ in range(10))]:
        packed = pack([code_points(t) for t in texts], np.unique(code_points(query)))
        assert distances(code_points(query).tolist(), packed).tolist() == [plain(query, t) for t in texts]


@pytest.mark.parametrize("bits", [10, 1 << 16])
def test_shares_of_all_titles_and_of_some(monkeypatch, bits):
    monkeypatch.setattr("lineseek.operators.edit_distance.PACK_BITS", bits)
    texts = [None, "", *(text(12) for _ in range(60)), "abc", "abc"]
    query = text(12) + "abc"
    titles = Titles(pa.array(texts), np.unique(code_points(query)))
    want = [(max(len(query), len(t)) - plain(query, t)) / max(len(query), len(t)) if t else 0.0 for t in texts]
    points = code_points(query).tolist()
    assert titles.matches(points).tolist() == want
    some = np.array([1, 5, 63])
    assert titles.matches(points, some).tolist() == [want[i] for i in some]
    for number, group in enumerate(titles.groups):
        assert titles.group_matches(points, number).max() <= titles.bound(len(query), number)
