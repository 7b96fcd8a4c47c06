import math

import pytest

from lineseek.llm import topk
from lineseek.llm.topk import top_k

SCHEMA = "vec_id bigint, embedding array<double>, label int, block string, ids string, score double"


def brute(rows, asked, k):
    usable = {(i, tuple(v)) for i, v in rows
              if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in usable]
    out = {}
    for i, v in whole:
        if i in asked:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in whole if j != i and len(w) == len(v))
            for rank, (score, j) in enumerate(scored[:k], 1):
                out[i, rank] = (j, -score)
    return out


def rows_of(rng):
    rows = [(i, [round(rng.gauss(0, 1), 2) for _ in range(6)]) for i in range(150)]
    rows += [(i, [1.0] + [0.0] * 5) for i in range(200, 240)]
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] + [0.0] * 5)]
    rows += [(304, []), (305, []), (306, [0.5, 0.25]), (307, [0.0] * 6), (None, [9.0] * 6), (5, rows[5][1])]
    rows += [(308, [1e6, -1e6, 1e6, 0.0, 0.0, 0.0]), (309, [1e6, 0.0, 0.0, 0.0, 0.0, 1e6])]
    return rows


@pytest.mark.parametrize(("size", "depth"), [(1 << 20, 64), (2000, 2)])
def test_against_brute_force(spark, rng, monkeypatch, size, depth):
    monkeypatch.setattr(topk, "BLOCK_BYTES", size)
    rows = rows_of(rng)
    df = spark.createDataFrame([(*row, 1, "b", "i", 0.5) for row in rows], SCHEMA).repartition(3)
    asked = set(range(0, 320, 7)) | {304, 306, 307, 308}
    got = top_k(df, df.where(df.vec_id.isin(list(asked))), 5).collect()
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got} == brute(rows, asked, 5)
    assert len(got) == len({(r.query_id, r["rank"]) for r in got})


def test_lists_stop_early(rng):
    import numpy as np

    matrix = np.array([[rng.gauss(0, 1) * 100 // 1, rng.gauss(0, 1) * 100 // 1] for _ in range(3000)])
    matrix[7] = [900, 900]
    lists = topk.SortedLists(np.arange(3000), matrix)
    read = []

    class Spy:
        def __getitem__(self, places):
            read.append(len(places))
            return matrix[places]

    lists.matrix = Spy()
    ids, scores = lists.top(-1, np.array([1.0, 1.0]), 1)
    assert (ids[0], scores[0]) == (7, 1800) and sum(read) < 300


def test_huge_components_hold_at_the_limit(spark):
    rows = [(0, [1e300, -1e300]), (1, [1e300, -1e300]), (2, [1e18, 1e18]), (3, [1.0, -1.0])]
    df = spark.createDataFrame([(*row, 1, "b", "i", 0.5) for row in rows], SCHEMA)
    got = [(r.query_id, r.vec_id, r.score) for r in top_k(df, df.where("vec_id = 0"), 2).orderBy("rank").collect()]
    assert got[0] == (0, 1, 2**63 - 1) and len(got) == 2


def test_copies_of_queries_are_not_broadcast(spark, monkeypatch):
    """They go to each group of vector blocks, past the driver, whatever size Spark takes them for."""
    monkeypatch.setattr(topk, "BLOCK_BYTES", 64)
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "100MB")
    try:
        df = spark.createDataFrame([(i, [float(i % 5), 1.0], 1, "b", "i", 0.5) for i in range(40)], SCHEMA)
        found = top_k(df, df.where("vec_id % 2 = 0"), 3)
        assert len(found.collect()) == 60
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(threshold, before)
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert top_k(df, df).collect() == []
