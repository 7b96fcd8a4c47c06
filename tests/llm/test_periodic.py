"""Runs of repeated words against a plain search of every period."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from lineseek.llm import periodic
from lineseek.llm.periodic import batch_fragments, periodic_runs, z_function
from lineseek.llm.queries import op12_periodic_runs


def brute(words):
    """Every run as (start, length, period): all maximal stretches of each period, multiples left out."""
    n, by_span = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                by_span.setdefault((i, j + q), q)
            i = j
    return sorted((a, b - a, q) for (a, b), q in by_span.items())


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def split(text):
    return [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in text or "").split(" ") if w]


def expected(doc_id, text, plant=True):
    words = split(text)
    words = planted(doc_id, words) if plant else words
    runs = brute(words)
    dropped = set()
    for a, n, p in runs:
        dropped.update(range(a + p, a + n))
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    return (
        len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest(),
    )


def told(row):
    return (row.n_runs, row.start, row.length, row.period, row.exponent_milli, row.runs_sha256, row.collapsed_sha256)


def solve(words):
    """Fragments of one document, stitched here."""
    codes = np.unique(words, return_inverse=True)[1]
    out = {}
    for q, a, b in sorted(batch_fragments(codes, np.array([0, len(codes)])).get(0, [])):
        spans = out.setdefault(q, [])
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b])
    return sorted((a, b - a + q, q) for q, spans in out.items() for a, b in spans if b - a + q >= max(6, 4 * q))


@pytest.fixture
def texts():
    rng = random.Random(5)

    def make(n):
        out = []
        while len(out) < n:
            unit = [rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.randint(1, 40))]
            out += unit * rng.choice([1, 1, 1, 2, 3, 4, 5, 9]) + unit[: rng.randint(0, len(unit))]
        return out[:n]

    return make


def test_z_function(texts):
    for n in (1, 2, 5, 40, 200):
        words = np.unique(texts(n), return_inverse=True)[1]
        z = z_function(words, n)
        for i in range(1, n):
            reach = 0
            while i + reach < n and words[reach] == words[i + reach]:
                reach += 1
            assert z[i] == reach


@pytest.mark.parametrize(("tile", "steps"), [(1024, 16), (4, 2)])
def test_runs_of_odd_texts(texts, monkeypatch, tile, steps):
    """Small tiles, so that runs span many of them."""
    monkeypatch.setattr(periodic, "TILE_WORDS", tile)
    monkeypatch.setattr(periodic, "TILE_STEPS", steps)
    rng = random.Random(1)
    for _ in range(300):
        words = texts(rng.choice([3, 6, 7, 20, 60, 150, 400]))
        assert solve(words) == brute(words), words
    for words in (["x"] * 700, ["x", "y"] * 350, list("abc") * 200 + ["z"] + list("abc") * 50):
        assert solve(words) == brute(words)


def test_one_word_repeated_has_few_fragments():
    found = batch_fragments(np.zeros(50_000, np.int64), np.array([0, 50_000]))[0]
    assert len(found) <= 50_000 // 1024 + 2 and {q for q, _, _ in found} == {1}


def test_documents_do_not_run_into_each_other(spark):
    rows = [(i, "a b") for i in range(40)]
    got = periodic_runs(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)).collect()
    assert all(row.n_runs == 0 for row in got)


def test_odd_rows(spark, texts):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 6), (4, "a " * 6), (None, "b c " * 5), (5, "a\va\fa\ra\ta a\n"),
            (6, " ".join(texts(3000))), (7, "  " * 8)]
    df = spark.createDataFrame([(*row, "n") for row in rows], "doc_id bigint, text string, key string")
    got = sorted(map(told, periodic_runs(df).collect()), key=repr)
    assert got == sorted((expected(i, text, plant=False) for i, text in rows), key=repr)
    assert periodic_runs(df.limit(0)).collect() == []


def test_query_against_every_period(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").collect()
    got = {row.doc_id: told(row) for row in op12_periodic_runs(spark, data).collect()}
    assert len(got) == len(rows)
    runs = 0
    for row in rows:
        assert got[row.doc_id] == expected(row.doc_id, row.text), row.doc_id
        runs += got[row.doc_id][0]
    assert runs > 0
