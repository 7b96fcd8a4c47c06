import hashlib
from collections import defaultdict

import numpy as np
import pytest

from lineseek.llm.exact_dedup import CountingQuotientFilter, drop_exact_duplicates, exact_duplicates, repeated_fingerprints

SCHEMA = "doc_id bigint, text string, fp string, sha int, norm int, row string"


def table(spark, rows):
    return spark.createDataFrame([(*row, "f", 1, 2, "r") for row in rows], SCHEMA)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_groups_against_brute_force(spark):
    rows = [(i, f"Text {i % 7}") for i in range(50)] + [(90, "ÄÖ"), (91, "äö"), (92, None), (93, ""), (94, "A"), (95, "a")]
    rows += [(96, "long " * 50_000), (97, "LONG " * 50_000)]
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[lowered(text)].append(doc_id)
    got = exact_duplicates(table(spark, rows).repartition(5)).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for row in got:
        norm = lowered(texts[row.doc_id])
        group = groups[norm]
        assert (row.keep_id, row.group_size, row.kept) == (max(group), len(group), row.doc_id == max(group))
        assert row.text_sha256 == hashlib.sha256(norm.encode()).hexdigest()


def test_rows_kept(spark):
    rows = [(1, "x"), (2, "X"), (3, "y"), (3, "y"), (3, "z"), (None, "x"), (None, "only")]
    kept = drop_exact_duplicates(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    assert sorted(map(str, ((row.doc_id, row.text) for row in kept.collect()))) == sorted(
        map(str, [(2, "X"), (3, "y"), (3, "z"), (None, "only")])
    )


def test_no_rows(spark):
    assert exact_duplicates(table(spark, []).limit(0)).collect() == []
    assert drop_exact_duplicates(table(spark, []).limit(0)).collect() == []


def test_a_third_of_all_rows_is_one_text(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i}") for i in range(3000)]
    got = exact_duplicates(table(spark, rows).repartition(4)).where("group_size > 1").collect()
    assert {(row.keep_id, row.group_size) for row in got} == {(2997, 1000)} and len(got) == 1000


@pytest.mark.parametrize("range_bits", [3, 8])
def test_filter_is_lossless(range_bits):
    rng = np.random.default_rng(3)
    values = rng.integers(0, 1 << 64, 5000, dtype=np.uint64)
    values = np.concatenate([values, values[:700], values[:30], np.array([0, 0, (1 << 64) - 1], np.uint64)])
    held = [CountingQuotientFilter.read(piece, range_bits)
            for piece in CountingQuotientFilter.of(values, range_bits).pieces(range_bits)]
    want, counts = np.unique(values, return_counts=True)
    assert (np.concatenate([fps for fps, _ in held]) == want).all()
    assert (np.concatenate([n for _, n in held]) == counts).all()


def test_filters_merge(spark):
    values = [i % 400 - 200 for i in range(1000)] + [10_000, -10_000]
    df = spark.createDataFrame([(v * 46_116_860_184_273,) for v in values], "fp bigint").repartition(6)
    got = {row.fp // 46_116_860_184_273: row.fp_rows for row in repeated_fingerprints(df).collect()}
    assert got == {v: values.count(v) for v in set(values) if values.count(v) > 1}
