"""Mixing sources to target weights: iterative proportional fitting, then sampling.

Documents are counted into cells (source, language, topic). Raking gives every
cell a factor so that the weighted tokens meet the target share of each source,
each language and each topic. A document is kept with its cell's factor as
probability, against a hash of its id: the same documents stay on every run.

A budget says how many tokens to keep. A cell can't give more than it holds, so a
value's goal is its share of the budget or all its tokens, whichever is less, and
what it lacks goes to the others. Without a budget factors have no upper bound and
are scaled in the end, so that the largest is 1.

All of it is DataFrame operations. The cell table has a row per cell, whatever
the number of documents, is rewritten once a round, and is broadcast only if it
was counted to be small, so sources may be many.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineseek.llm.work import materialise
from lineseek.session import broadcast_if_few

DIMENSIONS = ("source", "lang", "topic")
ROUNDS = 25  # at most
TOLERANCE = 1e-4  # rounds end when no value is off its goal by more than this share of the budget
TEMPERS = {"source": 0.7, "lang": 0.7, "topic": 1.0}  # targets not given: the corpus' own shares to this power
NONE = "(none)"
WORD = r"[^\x20\x09-\x0D]+"
BUDGET = 0.5  # share of the tokens that the registered query and the pipeline keep
LEVEL_STEPS = 100
DECIMALS = 9  # of a probability; a draw has steps of 2e-10


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; null has none."""
    words = F.regexp_count(text, F.lit(WORD))
    return F.coalesce(words, F.lit(0)).cast("long")


def topic_of(text: Column) -> Column:
    """Coarse topic by fixed marks: contact details, tables, licences, else prose."""
    text = F.coalesce(text, F.lit(""))
    return (
        F.when(F.contains(text, F.lit("@")) | F.contains(text, F.lit("://")), "contact")
        .when(F.contains(text, F.lit(" | ")), "table")
        .when(F.contains(text, F.lit("icense")) | F.contains(text, F.lit("opyright")), "licence")
        .otherwise("prose")
    )


def document_cells(
    documents: DataFrame, *, id_col: str, text_col: str, source_col: str, lang_col: str, topic: Column | None = None
) -> DataFrame:
    """``id, source, lang, topic, tokens`` per row; null source or language is its own value."""
    text = F.col(text_col)
    return documents.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(source_col), F.lit(NONE)).alias("source"),
        F.coalesce(F.col(lang_col), F.lit(NONE)).alias("lang"),
        (topic_of(text) if topic is None else topic).alias("topic"),
        word_count(text).alias("tokens"),
    )


def target_shares(cells: DataFrame, dimension: str, given: Mapping[str, float] | None) -> DataFrame:
    """``dimension, target``: given weights, or tempered shares; they add up to 1 over the values present."""
    present = cells.groupBy(dimension).agg(F.sum("tokens").alias("held"))
    if given:
        weights = F.create_map(*(F.lit(x) for pair in given.items() for x in (pair[0], float(pair[1]))))
        weighed = present.select(dimension, F.coalesce(weights[F.col(dimension)], F.lit(0.0)).alias("weight"))
    else:
        weighed = present.select(dimension, F.pow(F.col("held").cast("double"), TEMPERS[dimension]).alias("weight"))
    total = weighed.agg(F.sum("weight")).first()[0] or 1.0
    return weighed.select(dimension, (F.col("weight") / total).alias("target"))


class Calibration(NamedTuple):
    """``cells``: dimensions, ``tokens`` and ``probability``; ``residual``: the largest
    distance of a value from its goal, as a share of the budget; ``rounds`` taken."""

    cells: DataFrame
    residual: float
    rounds: int


def level(rows: DataFrame, held: Column, want: Column, goal: float) -> float:
    """The multiple of ``want`` at which ``want``, ``held`` at most, adds up to
    ``goal``. Newton steps from below; the sum is concave, so none goes too far."""
    total = rows.agg(F.sum(want)).first()[0]
    if not total:
        return 0.0
    at = goal / total
    for _ in range(LEVEL_STEPS):
        reached, rising = rows.agg(F.sum(F.least(held, want * at)), F.sum(F.when(want * at < held, want))).first()
        if not rising or goal - reached <= 1e-12 * goal:
            break
        at += (goal - reached) / rising
    return at


def calibrate(
    cells: DataFrame,
    targets: Mapping[str, DataFrame],
    budget: float | None = None,
    *,
    rounds: int = ROUNDS,
    tolerance: float = TOLERANCE,
) -> Calibration:
    """Factors at which ``tokens * least(factor, most)`` meets the goal of every value.

    ``most`` is 1 with a budget, a share of the tokens of the values with a target,
    and without bound otherwise. One dimension after the other is raked: a value above
    its goal is scaled down to it, one below gives what it lacks to its cells below
    ``most``. A value whose cells all are at ``most`` stays. Rounds end when all goals
    are met to ``tolerance``, or with the last.
    """
    most = float("inf") if budget is None else 1.0
    for target in targets.values():
        cells = cells.join(target.where("target > 0").drop("target"), target.columns[0], "left_semi")
    cells = materialise(cells.select(*DIMENSIONS, "tokens"), "cells")
    reachable = cells.agg(F.sum("tokens")).first()[0] or 0
    wanted = reachable * (1.0 if budget is None else budget)
    goals = {}
    for name, target in targets.items():
        held = materialise(cells.groupBy(name).agg(F.sum("tokens").alias("held")).join(target, name), "goals")
        bound = F.lit(most) if budget is None else F.col("held")
        goals[name] = materialise(
            held.select(name, F.least(bound, F.col("target") * level(held, bound, F.col("target"), wanted)).alias("goal")),
            "goals",
        )
    weighted = F.col("tokens") * F.least(F.col("factor"), F.lit(most))
    rising = F.when(F.col("factor") < most, F.col("tokens") * F.col("factor")).otherwise(0.0)
    change = (
        F.when(F.col("given") > F.col("goal"), F.col("goal") / F.col("given"))
        .when(F.col("rising") > F.col("goal") * 1e-9, 1 + (F.col("goal") - F.col("given")) / F.col("rising"))
        .otherwise(1.0)
    )
    cells = cells.withColumn("factor", F.lit(1.0 if budget is None else budget))
    residual, taken = 0.0, 0
    while wanted and taken < rounds:
        for name, goal in goals.items():
            given = cells.groupBy(name).agg(F.sum(weighted).alias("given"), F.sum(rising).alias("rising"))
            changes = given.join(goal, name).select(name, change.alias("change"))
            cells = cells.join(changes, name).select(
                *DIMENSIONS, "tokens", (F.col("factor") * F.col("change")).alias("factor")
            )
        cells = materialise(cells, "cells")
        off = [
            cells.groupBy(name).agg(F.sum(weighted).alias("given")).join(goal, name)
            .agg(F.max(F.abs(F.col("given") - F.col("goal"))).alias("off"))
            for name, goal in goals.items()
        ]
        residual = reduce(DataFrame.union, off).agg(F.max("off")).first()[0] / wanted
        taken += 1
        if residual <= tolerance:
            break
    largest = (cells.agg(F.max("factor")).first()[0] or 1.0) if budget is None else 1.0
    probability = F.round(F.least(F.col("factor") / F.lit(largest), F.lit(1.0)), DECIMALS)
    return Calibration(cells.select(*DIMENSIONS, "tokens", probability.alias("probability")), residual, taken)


def calibrate_documents(
    rows: DataFrame,
    targets: Mapping[str, Mapping[str, float]] | None,
    budget: float | None,
    rounds: int = ROUNDS,
    tolerance: float = TOLERANCE,
) -> Calibration:
    """``calibrate`` for rows of :func:`document_cells`."""
    cells = materialise(
        rows.where("tokens > 0").groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells"
    )
    wanted = {name: target_shares(cells, name, (targets or {}).get(name)) for name in DIMENSIONS}
    return calibrate(cells, wanted, budget, rounds=rounds, tolerance=tolerance)


def with_probability(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """``rows`` with the ``probability`` of their cell; 0 without words or cell.

    The cells go to every task if they are few; else Spark chooses the join."""
    named = cells.select(*(F.col(name).alias(f"cell_{name}") for name in DIMENSIONS), "probability")
    same = [F.col(name) == F.col(f"cell_{name}") for name in DIMENSIONS]
    joined = rows.join(
        broadcast_if_few(named, cells.count()), same[0] & same[1] & same[2] & (F.col("tokens") > 0), "left"
    )
    return joined.select(
        *(F.col(name) for name in rows.columns), F.coalesce("probability", F.lit(0.0)).alias("probability")
    )


def draw(identity: Column) -> Column:
    """A number in [0, 1) from the md5 of an id's text."""
    digest = F.md5(F.coalesce(identity.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(
    documents: DataFrame,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    topic: Column | None = None,
    budget: float | None = None,
    rounds: int = ROUNDS,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """``id_col, source, lang, topic, tokens, probability, kept`` for every row.

    ``targets`` names wanted weights per dimension, e.g. ``{"lang": {"en": 3,
    "de": 1}}``; values not named get none. Without them a dimension's target
    is its own share of tokens to the power 0.7 (topics: 1). ``budget`` is the share
    of the tokens with a target to keep; a value with too few tokens is then kept
    whole. Without it the rarest value decides how much is kept. Rows without a word
    have probability 0. Null source or language is a value of its own, a null id
    draws as the empty text. Repeated rows draw alike. Other columns don't
    matter. An empty table gives no rows.
    """
    rows = materialise(
        document_cells(
            documents, id_col=id_col, text_col=text_col, source_col=source_col, lang_col=lang_col, topic=topic
        ),
        "mixing",
    )
    found = calibrate_documents(rows, targets, budget, rounds, tolerance)
    return with_probability(rows, found.cells).select(
        F.col("id").alias(id_col),
        *DIMENSIONS,
        "tokens",
        "probability",
        (draw(F.col("id")) < F.col("probability")).alias("kept"),
    )


def sample_mixed(
    documents: DataFrame,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    topic: Column | None = None,
    budget: float | None = None,
    rounds: int = ROUNDS,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """The rows of ``documents`` that :func:`mix` keeps, all columns as they were.

    One pass counts the cells, a second looks each row's cell up and draws; where
    the cells are few no row is moved.
    """
    names = {"id_col": id_col, "text_col": text_col, "source_col": source_col, "lang_col": lang_col, "topic": topic}
    found = calibrate_documents(document_cells(documents, **names), targets, budget, rounds, tolerance)
    whole = documents.select(F.struct("*").alias("row"))
    text = F.col(f"row.{text_col}")
    keyed = whole.select(
        "row",
        F.col(f"row.{id_col}").alias("id"),
        F.coalesce(F.col(f"row.{source_col}"), F.lit(NONE)).alias("source"),
        F.coalesce(F.col(f"row.{lang_col}"), F.lit(NONE)).alias("lang"),
        (topic_of(text) if topic is None else topic).alias("topic"),
        F.coalesce(F.rlike(text, F.lit(WORD)), F.lit(False)).cast("int").alias("tokens"),
    )
    drawn = with_probability(keyed, found.cells)
    return drawn.where(draw(F.col("id")) < F.col("probability")).select("row.*")
