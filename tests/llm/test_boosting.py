"""Boosting over a table against boosting over arrays: every row counts."""

import numpy as np
import pytest

from lineseek.llm import boosting
from lineseek.llm.boosting import _cuts, fit, fit_counted


def test_all_rows_are_learned_from(spark, monkeypatch):
    monkeypatch.setattr(boosting, "TREES", 4)
    draw = np.random.default_rng(5)
    rows = draw.integers(0, 60, (6000, 3)).astype(float)
    rows[:, 2] = draw.integers(0, 5, 6000)
    labels = ((rows[:, 0] > 30) ^ (rows[:, 1] > 20)).astype(float)
    held = np.arange(6000) % 4 == 0
    table = [(0, int(y), bool(h), 1, r.tolist()) for r, y, h in zip(rows, labels, held, strict=True)]
    table += [(1, 1, False, 1, [1.0, 2.0, 3.0])]  # one label only
    df = spark.createDataFrame(table, "kind int, label int, held_out boolean, n bigint, features array<double>")
    cuts = boosting._bounds(df.where("not held_out"), 3)
    assert [c.tolist() for c in cuts[0]] == [_cuts(rows[~held, f]).tolist() for f in range(3)]
    found = fit_counted(df.repartition(3), 3, 0.9)
    assert list(found) == [0]
    model, bound = found[0]
    want = fit(rows[~held], labels[~held], trees=4)
    assert model.log_odds(rows) == pytest.approx(want.log_odds(rows), abs=1e-5)
    chances = want.probability(rows[held])
    assert bound == pytest.approx(boosting.calibrated_threshold(chances, labels[held], 0.9), abs=1e-3)


def test_more_than_a_sample_of_a_kind_and_label(spark, monkeypatch):
    """The rule only shows in the last rows of 5000, far beyond 2000 of each label."""
    monkeypatch.setattr(boosting, "TREES", 2)
    table = [(0, 0, False, 4000, [1.0]), (0, 1, False, 1000, [1.0]), (0, 1, False, 1, [9.0]), (0, 0, False, 1, [2.0])]
    df = spark.createDataFrame(table, "kind int, label int, held_out boolean, n bigint, features array<double>")
    model, bound = fit_counted(df, 1, 0.9)[0]
    assert model.offset == pytest.approx(np.log(1001 / 4001)) and bound == float("inf")


def test_levels_read_few_files_whatever_the_shuffle_partitions(spark, monkeypatch, setting):
    monkeypatch.setattr(boosting, "TREES", 2)
    monkeypatch.setattr(boosting, "ROWS_PER_TASK", 100)
    setting("spark.sql.adaptive.coalescePartitions.enabled", "false")
    setting("spark.sql.shuffle.partitions", "40")
    files, level = [], boosting._level

    def counted(binned, *rest):
        files.append(len(binned.inputFiles()))
        return level(binned, *rest)

    monkeypatch.setattr(boosting, "_level", counted)
    table = [(0, int(i > 90), False, 1 + i % 3, [float(i % 32), float(i // 32)]) for i in range(250)]
    df = spark.createDataFrame(table, "kind int, label int, held_out boolean, n bigint, features array<double>")
    many = fit_counted(df, 2, 0.9)[0][0]
    assert len(files) == 2 * boosting.DEPTH and max(files) <= 3
    setting("spark.sql.shuffle.partitions", "1")
    again = fit_counted(df, 2, 0.9)[0][0]
    assert np.array_equal(many.leaves, again.leaves) and np.array_equal(many.cuts, again.cuts)
