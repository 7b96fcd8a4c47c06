"""Divergences of sources against plain sums over every term."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lineseek.llm import divergence
from lineseek.llm.divergence import scaled_array, source_divergence, split_terms

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, term string"


def terms_of(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(rows):
    groups, holders, counts = defaultdict(set), defaultdict(set), defaultdict(Counter)
    for number, (text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        for term in terms_of(text):
            holders[lang, term].add(number)
            counts[lang, source][term] += 1
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for (g, t), held in holders.items() if g == lang and len(held) >= 3)
        v = len(kept)

        def chances(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (total + v) for t in kept}

        p = {s: chances(counts[lang, s]) for s in sources}
        q = chances(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s]
            told = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", told, 200)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def told(spark, rows, **options):
    df = spark.createDataFrame([(i, text, lang, source, "x") for i, (text, lang, source) in enumerate(rows)], SCHEMA)
    got = source_divergence(df.repartition(3), **options)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, got.collect()))


@pytest.fixture
def rows(words, rng):
    own = {f"s{i}": words(12) for i in range(7)}
    common = words(40)
    out = []
    for _ in range(220):
        source = rng.choice(["s0", "s0", "s0", *own])
        picked = [rng.choice(common + own[source]) for _ in range(rng.randint(0, 40))]
        text = rng.choice([" ", "-", "7", "\n"]).join(picked)
        out.append((text.upper() if rng.random() < 0.1 else text, rng.choice(["en", "en", "de", None]), source))
    return out + [(None, "en", None), ("", "xx", "a"), ("once", "xx", "b"), ("É é Àb àb éÉ", "fr", "a")] * 2 + [("é é", "fr", "b")] * 3


@pytest.mark.parametrize("batch", ["10000", "5"])
def test_against_plain_sums(spark, setting, rows, batch, monkeypatch):
    """Also with trees of few rows, and chunks of few combinations."""
    setting("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert told(spark, rows) == brute(rows)


def test_few_combinations_and_no_dense_table(rows, monkeypatch):
    rng = random.Random(2)
    paths, times = [], []
    for _ in range(60):
        names = sorted(rng.sample("abcdef", rng.randint(1, 6)))
        paths.append([{"source": s, "n": rng.randint(1, 3), "size": 50 + ord(s)} for s in names])
        times.append(rng.randint(1, 9))
    order = sorted(range(60), key=lambda i: [(x["source"], x["n"]) for x in paths[i]])
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["en"] * 60), pa.array([paths[i] for i in order]), pa.array([times[i] for i in order])],
        ["lang", "path", "times"],
    )
    p = lambda n, size: 1 + 10**9 * (n + 1) // size
    f = lambda a, b: (a - b) ** 2 // b
    want = Counter()
    for path, m in zip(paths, times, strict=True):
        for x in path:
            for y in path:
                if x is not y:
                    px, py, x0, y0 = p(x["n"], x["size"]), p(y["n"], y["size"]), p(0, x["size"]), p(0, y["size"])
                    want[x["source"], y["source"]] += m * (f(px, py) - f(px, y0) - f(x0, py) + f(x0, y0))
    for combinations, dense in ((1 << 20, 1 << 20), (7, 0)):
        monkeypatch.setattr(divergence, "COMBINATIONS", combinations)
        monkeypatch.setattr(divergence, "DENSE_PAIRS", dense)
        got = Counter()
        for part in divergence._correct(iter([batch])):
            for row in part.to_pylist():
                got[row["source"], row["item"]] += row["value"]
        assert got == want


def test_shared_rows_and_paths_make_one_node_each():
    """Rows a, ab, ab, ac of multiplicities 2, 3, 4, 5: nodes a (14), b (7), c (5)."""
    items = np.array([1, 1, 2, 1, 2, 1, 3])
    row, depth, times = divergence._nodes(items, np.zeros(4, np.int64), np.array([0, 1, 3, 5, 7]), np.array([2, 3, 4, 5]))
    assert list(zip(row.tolist(), depth.tolist(), times.tolist(), strict=True)) == [(0, 0, 14), (1, 1, 7), (3, 1, 5)]


def test_large_numbers():
    rng = random.Random(1)
    size = [rng.randint(1, 9 * 10**15) for _ in range(2000)]
    count = [rng.randint(0, s - 1) for s in size]
    assert scaled_array(np.array(count), np.array(size)).tolist() == [1 + 10**9 * (c + 1) // s for c, s in zip(count, size, strict=True)]


def test_terms(rng):
    texts = ["".join(rng.choices("aZz@[`{\x7f\x80é漢 \n09", k=rng.randint(0, 30))) for _ in range(300)] + ["", "Ünïcode's naïve_x"]
    found, bounds = split_terms(pa.array(texts))
    found = found.to_pylist()
    for i, text in enumerate(texts):
        assert found[bounds[i] : bounds[i + 1]] == terms_of(text)


def test_odd_tables(spark):
    assert told(spark, []) == []
    one = [("a b c", "en", "s")] * 3
    assert told(spark, one) == brute(one) == []
    two = [*one, ("", "en", "t")]
    assert told(spark, two) == brute(two)
    assert {r[2] for r in told(spark, two)} == {"pair", "term"} or told(spark, two)
