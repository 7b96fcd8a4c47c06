"""Suffix deduplication against a plain search of all strings of 100 bytes."""

import hashlib

import numpy as np
import pytest

from lineseek.llm import suffix_dedup
from lineseek.llm.suffix_dedup import COVER, COVER_PERIOD, _by_bucket, remove_repeats, resolve, sliding_least

SCHEMA = "doc_id bigint, text string, block string, bucket int, kind string"


def brute(rows):
    """doc_id -> (n_bytes, n_removed, n_spans, kept)."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda row: (row[0] is None, row[0])):
        raw = (text or "").encode()
        starts = []
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                starts.append(i)
            seen.add(raw[i : i + 100])
        gone = [False] * len(raw)
        for start in starts:
            gone[start : start + 100] = [True] * 100
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[doc_id] = (len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone) if not g))
    return out


def check(spark, rows, partitions):
    df = spark.createDataFrame([(*row, "x", 1, "y") for row in rows], SCHEMA).repartition(partitions)
    got = remove_repeats(df, with_text=True).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for row in got:
        assert (row.n_bytes, row.n_removed, row.n_spans, bytes(row.kept)) == want[row.doc_id], row.doc_id
        assert row.kept_sha256 == hashlib.sha256(want[row.doc_id][3]).hexdigest()


def test_the_cover_has_every_difference():
    assert {(a - b) % COVER_PERIOD for a in COVER for b in COVER} == set(range(COVER_PERIOD))


@pytest.mark.parametrize("partitions", [1, 6])
def test_passages_copies_and_periods(spark, words, rng, partitions):
    passages = [" ".join(words(30)) for _ in range(4)]
    exact = " ".join(words(60))
    rows = []
    for doc_id in range(60):
        parts = [" ".join(words(rng.randint(0, 40)))]
        if doc_id % 3 == 0:
            parts.append(passages[rng.randrange(4)])
        if doc_id % 5 == 0:
            parts.append(passages[rng.randrange(4)][rng.randrange(20) :])
        parts.append(" ".join(words(rng.randint(0, 30))))
        rows.append((doc_id, " ".join(parts)))
    rows += [(100 + i, exact) for i in range(8)] + [(200 + i, exact + "é" * i) for i in range(4)]
    rows += [(300, "a" * 500), (301, "ab" * 200), (302, "b" + "a" * 150), (303, "é" * 120)]
    rows += [(400, None), (401, ""), (402, "x" * 99), (403, "y" * 100), (404, "y" * 100), (405, "z" * 101), (None, exact)]
    check(spark, rows, partitions)


def test_no_rows(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_repeated_rows_count_once(spark):
    rows = [(1, "q" * 10 + "w" * 120)] * 2
    df = spark.createDataFrame([(*row, "x", 1, "y") for row in rows], SCHEMA)
    got = sorted(row.n_removed for row in remove_repeats(df).collect())
    assert got[1] == 130 and got[0] == brute([(1, rows[0][1])])[1][1]


def test_a_very_long_text(spark, words):
    long_text = " ".join(words(200_000))
    rows = [(1, long_text), (2, long_text[500_000:500_400]), (3, "u" + long_text[1_000:90_000])]
    check(spark, rows, 2)


def test_resolve_falls_back_on_bytes(monkeypatch, rng):
    contexts = np.frombuffer(bytes(rng.choices(b"ab", k=40 * suffix_dedup.CONTEXT)), np.uint8).reshape(40, -1).copy()
    contexts[1::2] = contexts[::2]
    masks = np.full(40, (1 << 64) - 1, np.uint64)
    ranks = np.array(rng.sample(range(40), 40))
    want = suffix_dedup._resolve_bytes(contexts, masks, ranks)
    assert (resolve(contexts, masks, ranks) == want).all()
    monkeypatch.setattr(suffix_dedup, "mixed", lambda keys: keys & np.uint64(3))
    assert (resolve(contexts, masks, ranks) == want).all()


def test_sliding_least(rng):
    values = np.array([rng.randrange(1000) for _ in range(300)], np.uint64)
    for width in (1, 2, 63, 64):
        assert list(sliding_least(values, width)) == [min(values[i : i + width]) for i in range(300 - width + 1)]


@pytest.mark.parametrize("bits", [4, 16, 21])
def test_buckets_of_any_number(rng, bits):
    hashes = np.array([rng.getrandbits(64) for _ in range(4000)] + [0, 2**64 - 1], np.uint64)
    order, buckets, starts = _by_bucket(hashes, bits)
    for bucket, start, end in zip(buckets, starts, [*starts[1:], len(hashes)]):
        assert list(order[start:end]) == [i for i, h in enumerate(hashes.tolist()) if h >> (64 - bits) == bucket]
    assert len(set(buckets)) == len({h >> (64 - bits) for h in hashes.tolist()})
