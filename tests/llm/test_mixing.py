from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from checks.compare import normal_rows
from lineseek.llm import oracle
from lineseek.llm.mixing import (
    BUDGET, DIMENSIONS, calibrate, calibrate_documents, document_cells, mix, sample_mixed, target_shares,
)

SCHEMA = "doc_id bigint, text string, source string, lang string, id int, topic string, tokens int, factor double"


def table(spark, rows):
    return spark.createDataFrame([(*row, 1, "t", 2, 0.5) for row in rows], SCHEMA)


@pytest.fixture
def rows(words, rng):
    out = []
    for doc_id in range(600):
        text = " ".join(words(rng.randint(5, 40))) + rng.choice(["", "", " me@x.org", " a | b", " License"])
        out.append((doc_id, text, rng.choice(["web", "web", "web", "books", "code", None]), rng.choice(["en", "en", "de", None])))
    return out + [(1000, None, "web", "en"), (1001, " \n", "web", "en"), (None, "some words here", "web", "en"), (5, "x y", "only", "xx")]


def shares(judged, name):
    held = defaultdict(float)
    for row in judged:
        held[row[name]] += row.tokens * row.probability
    total = sum(held.values())
    return {value: tokens / total for value, tokens in held.items()}


def test_weighted_tokens_meet_the_targets(spark, rows):
    judged = mix(table(spark, rows), rounds=12).collect()
    assert len(judged) == len(rows)
    own = {}
    for name, power in (("source", 0.7), ("lang", 0.7), ("topic", 1.0)):
        held = defaultdict(int)
        for row in judged:
            held[row[name]] += row.tokens
        powered = {value: tokens**power for value, tokens in held.items() if tokens}
        own[name] = {value: weight / sum(powered.values()) for value, weight in powered.items()}
        assert shares(judged, name) == pytest.approx(own[name], rel=2e-3, abs=1e-3)
    assert max(row.probability for row in judged) == pytest.approx(1.0)
    assert all(row.probability == 0 and not row.kept for row in judged if row.tokens == 0)
    kept = sum(row.tokens for row in judged if row.kept)
    expected = sum(row.tokens * row.probability for row in judged)
    variance = sum(row.tokens**2 * row.probability * (1 - row.probability) for row in judged)
    assert abs(kept - expected) <= 4 * variance**0.5


def test_given_targets(spark, rows):
    judged = mix(table(spark, rows), {"lang": {"en": 1, "de": 3}, "source": {"web": 1, "books": 1}}).collect()
    assert {k: v for k, v in shares(judged, "lang").items() if v} == pytest.approx({"en": 0.25, "de": 0.75}, rel=2e-3)
    assert all(row.probability == 0 for row in judged if row.source not in ("web", "books"))


def test_the_rows_kept(spark, rows):
    df = table(spark, rows).repartition(3)
    for budget in (None, 0.7):
        kept = sample_mixed(df, budget=budget)
        assert kept.columns == df.columns
        want = sorted(str(row.doc_id) for row in mix(df, budget=budget).where("kept").collect())
        assert sorted(str(row.doc_id) for row in kept.collect()) == want


def test_no_row_is_moved_to_be_drawn(spark, rows):
    plan = sample_mixed(table(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan and "hashpartitioning" not in plan


def test_no_python_and_no_rows(spark, rows):
    plan = mix(table(spark, rows[:50]), rounds=1)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert mix(table(spark, rows).limit(0), rounds=1).collect() == []
    assert sample_mixed(table(spark, rows).where(F.lit(False)), rounds=1).collect() == []


@pytest.fixture
def unbalanced(words, rng):
    """A source of five words, and two sources and a language that have too few tokens for their targets."""
    rows = [
        (i, " ".join(words(rng.randint(20, 60))), rng.choice(["web"] * 40 + ["books"] * 5 + ["code"]), rng.choice(["en", "en", "de"]))
        for i in range(600)
    ]
    return [*rows, (1000, "one two three four five", "tiny", "zz"), (1001, None, "web", None), (1002, "a | b", "web", "en")]


def plain(cells, targets, budget, rounds=60):
    """Factors of ``{(source, lang, topic): tokens}`` by bisection, value after value."""

    def solve(reached, goal, high=1e9):
        low = 0.0
        for _ in range(100):
            middle = (low + high) / 2
            low, high = (middle, high) if reached(middle) < goal else (low, middle)
        return high

    goals = []
    for place, target in enumerate(targets):
        held = defaultdict(int)
        for cell, tokens in cells.items():
            held[cell[place]] += tokens
        wanted = budget * sum(held.values())
        at = solve(lambda x: sum(min(held[v], target[v] * x) for v in held), wanted, 1e3 * wanted)
        goals.append({v: min(held[v], target[v] * at) for v in held})
    factors = dict.fromkeys(cells, budget)
    for _ in range(rounds):
        for place, goal in enumerate(goals):
            for value, wanted in goal.items():
                own = [cell for cell in cells if cell[place] == value]
                if sum(cells[c] for c in own) > wanted * (1 + 1e-12):
                    change = solve(lambda x: sum(cells[c] * min(factors[c] * x, 1) for c in own), wanted)
                else:
                    change = max(1 / min(factors[c] for c in own), 1)
                for cell in own:
                    factors[cell] *= change
    return {cell: min(factor, 1) for cell, factor in factors.items()}


@pytest.mark.parametrize("budget", [0.3, 0.6])
def test_budget_against_a_plain_version(spark, unbalanced, budget):
    rows = document_cells(table(spark, unbalanced), id_col="doc_id", text_col="text", source_col="source", lang_col="lang")
    counted = rows.where("tokens > 0").groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"))
    targets = {name: target_shares(counted, name, None) for name in DIMENSIONS}
    found = calibrate(counted, targets, budget, rounds=200, tolerance=1e-9)
    assert found.residual <= 1e-9 and found.rounds < 200
    cells = {tuple(row[name] for name in DIMENSIONS): row.tokens for row in counted.collect()}
    want = plain(cells, [{row[0]: row[1] for row in targets[name].collect()} for name in DIMENSIONS], budget)
    got = {tuple(row[name] for name in DIMENSIONS): row.probability for row in found.cells.collect()}
    assert got == pytest.approx(want, abs=1e-5)
    assert max(got.values()) == pytest.approx(1, abs=1e-5) and len({round(value, 3) for value in got.values()}) > 2


def test_a_tiny_source_does_not_shrink_the_others(spark, unbalanced):
    judged = mix(table(spark, unbalanced), budget=0.6).collect()
    total = sum(row.tokens for row in judged)
    assert sum(row.tokens * row.probability for row in judged) == pytest.approx(0.6 * total, rel=1e-3)
    assert all(row.probability == pytest.approx(1, abs=0.01) for row in judged if row.source in ("tiny", "code"))
    without_budget = mix(table(spark, unbalanced)).collect()
    assert sum(row.tokens * row.probability for row in without_budget) < 0.1 * total


def test_query_steps_against_sql(spark, unbalanced, tmp_path):
    """The SQL of the registered query on targets out of reach, at several budgets."""
    df = table(spark, unbalanced).select("doc_id", "text", "source", "lang")
    df.toPandas().to_parquet(tmp_path / "documents.parquet")
    connection = duck_of(tmp_path)
    for budget in (BUDGET, 0.8):
        want = connection.sql(oracle.mixing(budget=budget))
        got = mix(df, budget=budget)
        assert normal_rows(got.columns, [tuple(r) for r in got.collect()]) == normal_rows(want.columns, want.fetchall())


def duck_of(folder):
    import duckdb

    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    return connection


def test_goals_out_of_reach_end_with_a_residual(spark):
    rows = [(1, "a b c d", "web", "en"), (2, "a b c d", "books", "de")]
    cells = document_cells(table(spark, rows), id_col="doc_id", text_col="text", source_col="source", lang_col="lang")
    found = calibrate_documents(cells, {"source": {"web": 3, "books": 1}, "lang": {"en": 1, "de": 3}}, None, rounds=5)
    assert found.rounds == 5 and found.residual == pytest.approx(0.5, abs=1e-6)
