"""Gradient-boosted regression trees on the logistic loss.

Features are cut into at most ``BINS`` bins by their quantiles; every tree is
grown level by level, each node splitting where the gain of Newton steps is
largest (ties: first feature, lowest cut). Training is deterministic for a
given order of rows. A fitted model is a few arrays, sent to tasks as it is.

``fit`` learns from arrays. ``fit_counted`` learns from every row of a table: the
sums of a level's cells come from one aggregate, in whole numbers, so neither the
order nor the partitions of the rows matter, and what reaches the driver is a
bounded number of cells, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineseek.llm.work import materialise, tidy

BINS = 32
SCALE = 2.0**32  # slopes and weights are summed in whole multiples of 1 / SCALE
CHANCES = 1 << 16  # steps between 0 and 1 at which a threshold may lie
ROWS_PER_TASK = 20_000  # of distinct binned rows
SUMMING = 4  # tasks that end a level: it has at most some 26,000 cells, whatever the shuffle partitions
TREES, DEPTH, RATE, RIDGE, LEAST_WEIGHT = 60, 4, 0.2, 1.0, 1.0


@dataclass
class Boosted:
    """``offset`` plus the leaves that rows reach, as log odds.

    Node ``i`` of a tree sends a row to ``2i + 1`` if its feature is at most the
    cut, else to ``2i + 2``; the last level holds the leaves.
    """

    offset: float
    features: np.ndarray  # trees x inner nodes
    cuts: np.ndarray
    leaves: np.ndarray  # trees x leaves

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.offset)
        every = np.arange(len(rows))
        inner = self.features.shape[1]
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(rows), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (rows[every, feature[node]] > cut[node])
            total += leaf[node - inner] if len(node) else 0
        return total

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(rows), -50, 50)))


def _cuts(column: np.ndarray) -> np.ndarray:
    values = np.unique(column)
    if len(values) > BINS:
        values = np.unique(np.quantile(column, np.arange(1, BINS) / BINS, method="lower"))
    return values[:-1] if len(values) <= BINS and values[-1] == column.max() else values


def _splits(g: np.ndarray, h: np.ndarray) -> list[tuple[int, int, int]]:
    """Node, feature and bin of the best split of each node that gains by one, from running sums by bin."""
    all_g, all_h = g[:, :, -1:], h[:, :, -1:]
    gain = g**2 / (h + RIDGE) + (all_g - g) ** 2 / (all_h - h + RIDGE) - all_g**2 / (all_h + RIDGE)
    gain[(h < LEAST_WEIGHT) | (all_h - h < LEAST_WEIGHT)] = 0
    gain = np.round(gain, 9).reshape(len(g), -1)
    best = gain.argmax(axis=1)
    return [(int(i), *divmod(int(best[i]), BINS)) for i in np.flatnonzero(gain[np.arange(len(g)), best] > 0)]


def fit(rows: np.ndarray, labels: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Boosted | None:
    """A model of ``labels`` (0 or 1); none if only one label occurs."""
    if len(labels) == 0 or labels.min() == labels.max():
        return None
    n, width = rows.shape
    cuts = [_cuts(rows[:, f]) for f in range(width)]
    binned = np.stack([np.searchsorted(cuts[f], rows[:, f], side="left") for f in range(width)], axis=1)
    share = labels.mean()
    model = Boosted(
        float(np.log(share / (1 - share))),
        np.zeros((trees, 2**depth - 1), np.int64),
        np.full((trees, 2**depth - 1), np.inf),
        np.zeros((trees, 2**depth)),
    )
    score = np.full(n, model.offset)
    slot = binned + np.arange(width) * BINS
    for tree in range(trees):
        chance = 1 / (1 + np.exp(-np.clip(score, -50, 50)))
        slope, weight = labels - chance, chance * (1 - chance)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, held = 2**level - 1, 2**level
            place = ((node - first)[:, None] * (width * BINS) + slot).ravel()
            shape = (held, width, BINS)
            g = np.bincount(place, np.repeat(slope, width), held * width * BINS).reshape(shape).cumsum(axis=2)
            h = np.bincount(place, np.repeat(weight, width), held * width * BINS).reshape(shape).cumsum(axis=2)
            for i, feature, at in _splits(g, h):
                if at < len(cuts[feature]):
                    model.features[tree, first + i] = feature
                    model.cuts[tree, first + i] = cuts[feature][at]
            node = 2 * node + 1 + (rows[np.arange(n), model.features[tree, node]] > model.cuts[tree, node])
        leaf = node - (2**depth - 1)
        g = np.bincount(leaf, slope, 2**depth)
        h = np.bincount(leaf, weight, 2**depth)
        model.leaves[tree] = RATE * g / (h + RIDGE)
        score += model.leaves[tree][leaf]
    return model


@dataclass
class _Growing:
    """A model over bins: a row goes left if its bin is at most the split's. ``tree`` is the one that grows."""

    model: Boosted
    splits: np.ndarray  # trees x inner nodes; BINS where there is none
    tree: int = 0

    def score(self, bins: np.ndarray) -> np.ndarray:
        total = np.full(len(bins), self.model.offset)
        for tree in range(self.tree):
            total += self.model.leaves[tree][self.node(bins, tree, DEPTH) - (2**DEPTH - 1)]
        return total

    def node(self, bins: np.ndarray, tree: int, depth: int) -> np.ndarray:
        node, every = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(depth):
            node = 2 * node + 1 + (bins[every, self.model.features[tree, node]] > self.splits[tree, node])
        return node


def _bounds(rows: DataFrame, width: int) -> dict[int, list[np.ndarray]]:
    """Cuts of each kind's features, as ``_cuts`` gives them for all of its rows."""
    each = rows.select("kind", "n", F.posexplode("features").alias("feature", "value"))
    held = each.groupBy("kind", "feature", "value").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy("kind", "feature")
    upto = F.sum("n").over(whole.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    known = held.select(
        "*", upto.alias("upto"), F.sum("n").over(whole).alias("every"), F.count("*").over(whole).alias("distinct"),
        F.max("value").over(whole).alias("most"),
    )
    place = lambda k: F.floor(k * (F.col("every") - 1) / BINS)
    chosen = F.exists(
        F.sequence(F.lit(1), F.lit(BINS - 1)), lambda k: (place(k) < F.col("upto")) & (place(k) >= F.col("upto") - F.col("n"))
    )
    found = known.where((F.col("distinct") <= BINS) | chosen).select("kind", "feature", "value", "most").collect()
    cuts: dict[int, list[np.ndarray]] = {}
    for kind in {row.kind for row in found}:
        own = [row for row in found if row.kind == kind]
        values = [sorted(row.value for row in own if row.feature == f) for f in range(width)]
        most = {row.feature: row.most for row in own}
        cuts[kind] = [np.array(v[:-1] if len(v) <= BINS and v[-1] == most[f] else v) for f, v in enumerate(values)]
    return cuts


def _binned(rows: DataFrame, cuts: dict[int, list[np.ndarray]], width: int) -> DataFrame:
    """``kind, label, held_out, bins, n``: rows alike in all bins are one, with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column(0).to_numpy()
            values = batch.column(4).flatten().to_numpy().reshape(-1, width)
            bins = np.zeros(values.shape, np.uint8)
            for kind in np.unique(kinds):
                mine = np.flatnonzero(kinds == kind)
                for feature, bounds in enumerate(cuts.get(int(kind), [])):
                    bins[mine, feature] = np.searchsorted(bounds, values[mine, feature], side="left")
            packed = pa.array([row.tobytes() for row in bins], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), packed], names)

    names = ["kind", "label", "held_out", "n", "bins"]
    coded = rows.select("kind", "label", "held_out", "n", "features").mapInArrow(
        tidy(run), "kind int, label int, held_out boolean, n bigint, bins binary"
    )
    alike = coded.groupBy("kind", "label", "held_out", "bins").agg(F.sum("n").alias("n"))
    return materialise(alike, "binned")


def _bins(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, width)


def _level(binned: DataFrame, growing: dict[int, _Growing], width: int, level: int) -> dict[int, np.ndarray]:
    """For each kind, slopes and weights summed by node of ``level``, feature and bin, of all rows."""
    cells = 2**level * width * BINS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {kind: np.zeros((2, cells), np.int64) for kind in growing}
        for batch in batches:
            kinds, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            bins, times = _bins(batch, width), batch.column(4).to_numpy()
            for kind, grown in growing.items():
                mine = np.flatnonzero(kinds == kind)
                own = bins[mine]
                chance = 1 / (1 + np.exp(-np.clip(grown.score(own), -50, 50)))
                node = grown.node(own, grown.tree, level) - (2**level - 1)
                place = (node[:, None] * width + np.arange(width)) * BINS + own
                for row, part in enumerate((labels[mine] - chance, chance * (1 - chance))):
                    whole = np.rint(part * SCALE).astype(np.int64) * times[mine]
                    np.add.at(sums[kind][row], place.ravel(), np.repeat(whole, width))
        for kind, (g, h) in sums.items():
            met = np.flatnonzero(g | h)
            columns = [np.full(len(met), kind, np.int32), met, g[met], h[met]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["kind", "cell", "g", "h"])

    added = binned.select("kind", "label", "held_out", "bins", "n").mapInArrow(add, "kind int, cell bigint, g bigint, h bigint")
    found = added.groupBy("kind", "cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).coalesce(SUMMING).toArrow()
    kinds, cell, g, h = (found[name].to_numpy() for name in ("kind", "cell", "g", "h"))
    out = {}
    for kind in growing:
        mine = kinds == kind
        table = np.zeros((2, cells))
        table[0, cell[mine]], table[1, cell[mine]] = g[mine] / SCALE, h[mine] / SCALE
        out[kind] = table.reshape(2, 2**level, width, BINS).cumsum(axis=3)
    return out


def fit_counted(rows: DataFrame, width: int, precision: float) -> dict[int, tuple[Boosted, float]]:
    """A model and its threshold for each ``kind`` of ``rows(kind, label, held_out, n, features)``.

    Every row counts, ``n`` times: those held out calibrate, the others are learned from, as by
    ``fit`` and ``calibrated_threshold`` (thresholds lie at steps of 1 / ``CHANCES``). Kinds with
    one label only have no model. Each level of a tree is one aggregate for all kinds.
    """
    learned = rows.where(~F.col("held_out"))
    cuts = _bounds(learned, width)
    binned = _binned(rows, cuts, width)
    counts = {(r.kind, r.label): r.n for r in binned.where(~F.col("held_out")).groupBy("kind", "label").agg(
        F.sum("n").alias("n")).collect()}
    growing = {}
    for kind in sorted(cuts):
        wrong, right = counts.get((kind, 0), 0), counts.get((kind, 1), 0)
        if wrong and right:
            model = Boosted(
                float(np.log(right / wrong)), np.zeros((TREES, 2**DEPTH - 1), np.int64),
                np.full((TREES, 2**DEPTH - 1), np.inf), np.zeros((TREES, 2**DEPTH)),
            )
            growing[kind] = _Growing(model, np.full((TREES, 2**DEPTH - 1), BINS))
    if not growing:
        return {}
    tasks = 1 + binned.count() // ROWS_PER_TASK
    # each level reads these rows again: one file a task, not one for each shuffle partition
    few = materialise(binned.coalesce(tasks), "binned-few").coalesce(tasks)
    train, held = few.where(~F.col("held_out")), few.where("held_out")
    for tree in range(TREES):
        for level in range(DEPTH):
            first = 2**level - 1
            for kind, (g, h) in _level(train, growing, width, level).items():
                grown, left = growing[kind], np.full(2**level, BINS)
                model = grown.model
                for i, feature, at in _splits(g, h):
                    if at < len(cuts[kind][feature]):
                        model.features[tree, first + i], model.cuts[tree, first + i] = feature, cuts[kind][feature][at]
                        grown.splits[tree, first + i] = left[i] = at
                if level == DEPTH - 1:
                    nodes = np.arange(2**level)
                    feature, at = model.features[tree, first + nodes], np.minimum(left, BINS - 1)
                    for row, sums in enumerate((g, h)):
                        side = sums[nodes, feature, at]
                        both = np.stack([side, sums[nodes, feature, -1] - side], axis=1).ravel()
                        leaves = both if row == 0 else leaves / (both + RIDGE)
                    model.leaves[tree] = RATE * leaves
        for grown in growing.values():
            grown.tree = tree + 1
    bounds = _thresholds(held, growing, width, precision)
    return {kind: (grown.model, bounds[kind]) for kind, grown in growing.items()}


def _thresholds(held: DataFrame, growing: dict[int, _Growing], width: int, precision: float) -> dict[int, float]:
    """For each kind, the least step from which on rows held out are right with at least ``precision``."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, steps = batch.column(0).to_numpy(), np.full(len(batch), -1, np.int64)
            bins = _bins(batch, width)
            for kind, grown in growing.items():
                mine = np.flatnonzero(kinds == kind)
                chance = 1 / (1 + np.exp(-np.clip(grown.score(bins[mine]), -50, 50)))
                steps[mine] = np.floor(chance * CHANCES)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(steps), batch.column(1), batch.column(4)], ["kind", "step", "label", "n"]
            )

    judged = held.select("kind", "label", "held_out", "bins", "n").mapInArrow(
        judge, "kind int, step bigint, label int, n bigint"
    )
    right = F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0))
    found = judged.groupBy("kind", "step").agg(F.sum("n").alias("n"), right.alias("right")).toArrow()
    kinds, steps, n, right = (found[name].to_numpy() for name in ("kind", "step", "n", "right"))
    bounds = {}
    for kind in growing:
        mine = np.flatnonzero(kinds == kind)
        mine = mine[np.argsort(-steps[mine])]
        good = np.flatnonzero(np.cumsum(right[mine]) >= precision * np.cumsum(n[mine]))
        bounds[kind] = float(steps[mine][good[-1]]) / CHANCES if len(good) else float("inf")
    return bounds


def calibrated_threshold(chances: np.ndarray, labels: np.ndarray, precision: float) -> float:
    """The least threshold above which rows not used for fitting are right with
    at least ``precision``; infinite if there is none. Equal chances stand together."""
    if len(chances) == 0:
        return float("inf")
    order = np.argsort(-chances, kind="stable")
    right = np.cumsum(labels[order]) / np.arange(1, len(order) + 1)
    last_of_tie = np.append(chances[order][1:] != chances[order][:-1], True)
    good = np.flatnonzero((right >= precision) & last_of_tie)
    return float(chances[order][good[-1]]) if len(good) else float("inf")
