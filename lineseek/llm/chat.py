"""Chat formatting: logged snapshots of one conversation collapse to the longest, then are rendered.

A log often holds the same conversation again after every answer. Each turn
gets a rolling hash of all turns up to it; a conversation whose last rolling
hash occurs inside a longer one is a prefix of it. Anti-joins drop those, and
only what stays is rendered, turn by turn, so that no conversation, however
long, is gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineseek.llm.work import materialise

TURNS_PER_CHUNK = 1024  # turn numbers that a window sorts together
LANES = ["h0", "h1", "h2", "h3"]  # a rolling hash is four sums of 32 bits each


def rendered_turn(role: Column, text: Column) -> Column:
    """One turn in the ChatML layout."""
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))


def _turn_hash(place: Column) -> list[Column]:
    digest = F.md5(F.concat_ws("\x00", place.cast("string"), F.length("role").cast("string"), "role", "text"))
    return [F.conv(F.substring(digest, 8 * lane + 1, 8), 16, 10).cast("long").alias(name)
            for lane, name in enumerate(LANES)]


def _running(turns: DataFrame, order: list, sums: dict[str, Column]) -> DataFrame:
    """``turns`` with running totals over each conversation, in two levels:
    within chunks of turn numbers, then over the chunks' totals."""
    within = Window.partitionBy("conv", "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = turns.select("*", *(F.sum(value).over(within).alias(f"in_{name}") for name, value in sums.items()))
    totals = turns.groupBy("conv", "chunk").agg(*(F.sum(value).alias(name) for name, value in sums.items()))
    before = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        F.col("conv").alias("c"),
        F.col("chunk").alias("k"),
        *(F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"to_{name}") for name in sums),
    )
    joined = local.join(starts, (F.col("conv") == F.col("c")) & (F.col("chunk") == F.col("k")))
    return joined.select(
        *turns.columns, *((F.col(f"in_{name}") + F.col(f"to_{name}")).alias(name) for name in sums)
    )


def maximal_conversations(
    conversations: DataFrame,
    *,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """The turns of every conversation that is no prefix of a longer one:
    ``id_col, turn_no, n_turns, role, start, n_chars, rendered, copies``.

    Turns are read in the order of turn number (null first), role, text, and
    numbered from 1; ``start`` is where a turn begins in its conversation's
    rendering, in characters. Of conversations with equal turns (role and text)
    the smallest id stays, ``copies`` counts them. A null role or text counts
    as empty; a row repeated within a conversation counts once; rows without an
    id belong to no conversation. Other columns don't matter. An empty table
    gives no rows.
    """
    turns = (
        conversations.where(F.col(id_col).isNotNull())
        .select(
            F.col(id_col).alias("conv"),
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        )
        .distinct()
        .withColumn("chunk", F.coalesce(F.floor(F.col("turn") / TURNS_PER_CHUNK), F.lit(-(1 << 60))))
    )
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    placed = _running(turns, order, {"place": F.lit(1)})
    placed = placed.select("*", *_turn_hash(F.col("place")), F.length(rendered_turn(F.col("role"), F.col("text"))).alias("size"))
    rolling = _running(placed.drop("turn"), ["place"], {f"p{lane}": F.col(lane) for lane in LANES} | {"end": F.col("size")})
    rolling = materialise(rolling.drop(*LANES, "chunk"), "turns")

    prefix = [f"p{lane}" for lane in LANES]
    whole = rolling.groupBy("conv").agg(
        F.max("place").alias("n_turns"), F.max_by(F.struct(*prefix), "place").alias("whole")
    )
    inner = (
        rolling.select("conv", "place", F.struct(*prefix).alias("whole"))
        .join(whole.select("conv", "n_turns"), "conv")
        .where("place < n_turns")
        .select(F.col("place").alias("n_turns"), "whole")
        .distinct()
    )
    kept = (
        whole.groupBy("n_turns", "whole")
        .agg(F.min("conv").alias("conv"), F.count("*").alias("copies"))
        .join(inner, ["n_turns", "whole"], "left_anti")
        .select("conv", "n_turns", "copies")
    )
    return rolling.join(kept, "conv").select(
        F.col("conv").alias(id_col),
        F.col("place").alias("turn_no"),
        "n_turns",
        "role",
        (F.col("end") - F.col("size")).alias("start"),
        F.col("size").cast("long").alias("n_chars"),
        rendered_turn(F.col("role"), F.col("text")).alias("rendered"),
        "copies",
    )
