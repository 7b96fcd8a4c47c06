"""Pruned retrieval, the scan of packed rows and the closest titles against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineseek import index_tables
from lineseek.operators import lemmas as lemma_module
from lineseek.operators import pair_scan, ranking, retrieval
from lineseek.operators.ranking import best_titles
from lineseek.operators.retrieval import best_documents, keyword_hits
from lineseek.operators.vectors import nearest_exact
from lineseek.plans.search import keyword_search
from lineseek.session import broadcast_if_few

rng = random.Random(4)
TERMS = [f"t{i}" for i in range(40)]


@pytest.fixture(scope="module")
def rows():
    """Postings with a few heavy documents, and queries of few terms."""
    weights = {}
    for doc in range(3000):
        for term in rng.sample(TERMS, rng.randint(1, 6)):
            weights[term, doc] = float(rng.choice([1, 1, 1, 2, 2, 3, 20 if doc % 500 == 7 else 4]))
    asked = [(q, term) for q in range(30) for term in rng.sample(TERMS, rng.randint(1, 4))] + [(30, "absent"), (31, "")]
    return weights, asked


def brute_scores(weights, asked):
    by_term = defaultdict(list)
    for (term, doc), w in weights.items():
        by_term[term].append((doc, w))
    scores = defaultdict(lambda: defaultdict(float))
    for q, term in set(asked):
        for doc, w in by_term.get(term, []):
            scores[q][doc] += w
    return scores


def tables(spark, rows):
    weights, asked = rows
    matched = spark.createDataFrame([(t, d, w) for (t, d), w in weights.items()], "term string, doc_id bigint, weight double")
    return matched.repartition(4), spark.createDataFrame(asked, "query_id bigint, term string")


@pytest.mark.parametrize(("docs", "queries", "cells"), [(1024, 1024, 2_000_000), (50, 4, 60)])
def test_best_documents(spark, rows, monkeypatch, docs, queries, cells):
    """Also in small blocks and pieces. A task returns k rows a query and ties, whatever matches."""
    monkeypatch.setattr(retrieval, "DOCS_PER_BLOCK", docs)
    monkeypatch.setattr(retrieval, "QUERIES_PER_BLOCK", queries)
    monkeypatch.setattr(retrieval, "CELLS", cells)
    matched, terms = tables(spark, rows)
    want = {
        q: sorted(found.items(), key=lambda x: (-x[1], x[0]))[:5] for q, found in brute_scores(*rows).items() if found
    }
    got = defaultdict(list)
    for r in keyword_hits(matched, terms, 5, F.lit(3000), 32).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.id, pytest.approx(r.score)))
    assert {q: [d for d, _ in v] for q, v in got.items()} == {q: [d for d, _ in v] for q, v in want.items()}
    assert all(want[q] == v for q, v in got.items())


def test_rows_are_bounded(spark, setting):
    """One term in every document, no ties: far fewer rows than pairs."""
    setting("spark.sql.adaptive.enabled", "false")
    weights = {("a", doc): 1.0 + (doc * 7919 % 20_000) / 20_000 for doc in range(20_000)}
    matched, terms = tables(spark, (weights, [(q, "a") for q in range(50)]))
    found = best_documents(matched, terms, 3, F.lit(20_000), 50)
    partitions = found.rdd.getNumPartitions()
    assert found.count() <= 3 * 50 * partitions < 50 * 20_000 / 10


def test_blocks_that_cannot_win_are_skipped(monkeypatch):
    """A block of weak postings is not added up once k better ones are known."""
    import pyarrow as pa

    def block(weight, first):
        return retrieval._Postings(pa.array([{"term": "a", "id": first + i, "weight": weight} for i in range(10)]))

    best = retrieval._Best(pa.array([{"query_id": 1, "terms": ["a"]}]), 5)
    best.add(block(3.0, 0), 0.0)
    calls = []
    monkeypatch.setattr(retrieval._Postings, "scores", lambda *a: calls.append(a))
    best.add(block(2.0, 100), 0.0)
    assert calls == []


def test_keyword_search_ranks_ties_by_id(spark):
    documents = spark.createDataFrame(
        [(i, "", "alpha beta" if i % 2 else "alpha", "{}") for i in range(12)],
        "id bigint, title string, content string, original_entry string",
    )
    asked = spark.createDataFrame([(1, "beta alpha"), (2, "zeta"), (3, "")], "query_id bigint, query string")
    found = keyword_search(index_tables(documents, dim=2), asked, limit=8, decimals=6)
    assert [(r.query_id, r.id) for r in found.orderBy("query_id", "rank").collect()] == [(1, i) for i in (1, 3, 5, 7, 9, 11, 0, 2)]
    assert keyword_search(index_tables(documents, dim=2), asked, limit=0).count() == 0


def test_a_hundred_thousand_queries_in_one_scan(spark, tmp_path):
    vectors = np.random.default_rng(0).normal(size=(300, 6)).astype(np.float32)
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id bigint, vec array<float>").repartition(3).write.parquet(path)
    documents = spark.read.parquet(path)
    asked = spark.range(100_000).select(
        F.col("id").alias("query_id"),
        F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.sin(F.col("id") * i + i).cast("float")).alias("query_vec"),
    )
    found = nearest_exact(documents, asked, 2)
    assert found._jdf.queryExecution().toString().count(f"Location: InMemoryFileIndex(1 paths)[file:{path}") <= 1
    got = np.full((100_000, 2), -1)
    for r in found.select("query_id", "rank", "id").toPandas().itertuples():
        got[r.query_id, r.rank - 1] = r.id
    ids, steps = np.arange(100_000)[:, None], np.arange(1, 7)
    queries = np.sin(ids * steps + steps).astype(np.float32).astype(float)
    cosines = (queries / np.linalg.norm(queries, axis=1, keepdims=True)) @ (vectors / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)).T
    best = np.sort(cosines, axis=1)[:, ::-1][:, :2]
    assert np.allclose(np.take_along_axis(cosines, got, axis=1), best, atol=1e-6)


def test_a_shared_floor_changes_nothing(spark, monkeypatch):
    documents = spark.createDataFrame([(i, [float(i % 13), float(i % 7), 1.0]) for i in range(400)], "id bigint, vec array<float>")
    asked = spark.createDataFrame([(q, [float(q), 1.0, -1.0]) for q in range(5)], "query_id bigint, query_vec array<float>")
    plain = sorted(map(tuple, nearest_exact(documents, asked, 4, decimals=6).collect()))
    monkeypatch.setattr(pair_scan, "SAMPLE_FROM", 1)
    monkeypatch.setattr(pair_scan, "SAMPLE_SHARE", 3)
    assert sorted(map(tuple, nearest_exact(documents, asked, 4, decimals=6).collect())) == plain


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_best_titles(spark, monkeypatch):
    """Close titles without a common word are found; empty and null titles match nothing."""
    monkeypatch.setattr(ranking, "SAMPLE_SHARE", 4)
    words = ["alpha", "alphas", "beta", "Bêta", "gamma ray", "x"]
    titles = [(i, " ".join(rng.choices(words, k=rng.randint(0, 4)))) for i in range(120)] + [(120, None), (121, "alphabet")]
    asked = [(0, "Alphabets"), (1, ""), (2, "bêta x gamma"), (3, None), (4, "completely different and rather long")]
    got = best_titles(
        spark.createDataFrame(titles, "id bigint, title string"),
        spark.createDataFrame(asked, "query_id bigint, query string"), 6, decimals=6,
    ).collect()
    for q, query in asked:
        def match(title):
            left, right = (query or "").lower(), (title or "").lower()
            longer = max(len(left), len(right))
            return round((longer - distance(left, right)) / longer, 6) if right else 0.0

        want = sorted(((-match(title), i) for i, title in titles))[:6]
        mine = sorted((r.rank, r.id, r.title_match) for r in got if r.query_id == q)
        assert [(i, pytest.approx(s)) for _, i, s in mine] == [(i, -s) for s, i in want]


def test_best_titles_of_equal_ones_and_without_pairs_as_rows(spark, capsys):
    """The least ids of equal titles, and no edit distance per pair in the plan."""
    rows = spark.range(3000).select(F.col("id"), F.lit("same title").alias("title"))
    asked = spark.createDataFrame([(0, "Same titles"), (1, "same title")], "query_id bigint, query string")
    best = best_titles(rows, asked, 3)
    assert sorted((r.query_id, r.rank, r.id) for r in best.collect()) == [(q, k + 1, k) for q in (0, 1) for k in range(3)]
    capsys.readouterr()
    best.explain()
    assert "levenshtein" not in capsys.readouterr().out.lower()


def test_many_rows_are_not_gathered_however_small_they_look(spark):
    """Catalyst would broadcast this table; it is told that it has many rows."""
    few = spark.range(5).withColumnRenamed("id", "key")
    rows = spark.range(1000).select((F.col("id") % 5).alias("key"))
    plan = rows.join(broadcast_if_few(few, 10**6), "key")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    assert "Broadcast" in rows.join(broadcast_if_few(few, 5), "key")._jdf.queryExecution().executedPlan().toString()


def _tied(spark, n, tasks):
    zeros = F.array_repeat(F.lit(0.0).cast("float"), 2)
    signals = spark.range(n).repartition(tasks).select(
        "id", F.lit("web").alias("title"), zeros.alias("content_vec"), zeros.alias("title_vec")
    )
    asked = spark.createDataFrame(
        [(q, "some text", None) for q in range(3)], "query_id bigint, query string, query_vec array<float>"
    )
    return pair_scan.candidate_pairs(signals, asked, semantic_weight=0.7, title_weight=0.3, threshold=None, limit=4)


def test_ties_leave_the_scan_by_id(spark):
    found = _tied(spark, 3000, 2).collect()
    assert len(found) <= 3 * 2 * 4 * 2  # queries, tasks, limit, rows of documents in a task
    for q in range(3):
        assert sorted(r.id for r in found if r.query_id == q)[:4] == [0, 1, 2, 3]


def test_queries_go_along_once_a_task(spark, monkeypatch):
    """Not with every row of documents, of which a batch holds many."""
    monkeypatch.setattr(pair_scan, "DOCS_PER_ROW", 10)
    monkeypatch.setattr(pair_scan, "QUERIES_PER_SCAN", 1)
    found = _tied(spark, 300, 2)
    assert {r.query_id for r in found.collect()} == {0, 1, 2}
    assert "monotonically_increasing_id" in found._jdf.queryExecution().analyzed().toString()


def test_lemmas_are_joined_once_and_without_texts(spark, monkeypatch):
    written = []
    keep = lemma_module.materialise
    monkeypatch.setattr(lemma_module, "materialise", lambda df, label: written.append(df.columns) or keep(df, label))
    documents = spark.createDataFrame(
        [(0, "Cats sat", "cats cats dogs", "{}"), (1, "", "mats", "{}"), (2, None, None, "{}")],
        "id bigint, title string, content string, original_entry string",
    )
    lemmas = spark.createDataFrame([("cats", "cat"), ("mats", "mat")], "token string, lemma string")
    index = index_tables(documents, dim=2, lemmas=lemmas)
    got = {(r.doc_id, r.term): (r.tf, r.doc_len) for r in index.postings.collect()}
    assert got == {(0, "cat"): (5, 9), (0, "dogs"): (1, 9), (0, "sat"): (3, 9), (1, "mat"): (1, 1)}
    assert len(written) == 1 and not {"content", "title", "original_entry"} & set(written[0])
