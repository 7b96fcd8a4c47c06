from collections import Counter

import pytest
from brute import Corpus
from pyspark.sql import functions as F

from lineseek.operators.keyword import (
    bm25_scores,
    count_tokens,
    document_frequency,
    keyword_relevance,
    postings,
    tfidf_scores,
)
from lineseek.operators.query import expand_synonyms, query_terms
from lineseek.plans.build import tokenised

DOCS = [
    (0, "Red fox", "The red fox runs, red and quick", None, None),
    (1, "", "slow snails", None, None),
    (2, "Fox", "", None, None),
    (3, "...", "!!!", None, None),
    (4, "quick", "quick quick quick", None, None),
]
CORPUS = Corpus(DOCS)


@pytest.fixture(scope="module")
def posted(spark):
    docs = spark.createDataFrame([d[:3] for d in DOCS], "id bigint, title string, content string")
    return postings(tokenised(docs))


def terms_of(spark, *texts):
    return query_terms(spark.createDataFrame(list(enumerate(texts)), "query_id bigint, query string"))


def test_count_tokens(spark):
    rows = [["b", "a", "b", "b", "c", "a"], [], ["x"], ["é", "e", "é"], ["a"] * 500 + ["b"]]
    df = spark.createDataFrame([(r,) for r in rows], "w array<string>")
    got = [r[0] for r in df.select(count_tokens(F.col("w"))).collect()]
    assert [{p.term: p.tf for p in g or []} for g in got] == [dict(Counter(r)) for r in rows]
    assert [len(g or []) for g in got] == [len(set(r)) for r in rows]


def test_titles_count_three_times(posted):
    found = {}
    for r in posted.collect():
        found.setdefault(r.doc_id, {})[r.term] = r.tf
        assert r.doc_len == sum(CORPUS.tf[r.doc_id].values())
    assert found == {d: dict(c) for d, c in CORPUS.tf.items() if c}


def test_scores(spark, posted):
    terms = document_frequency(posted, F.lit(len(DOCS)))
    asked = terms_of(spark, "quick red fox", "fox fox FOX", "", "absent", "the")
    for name, scores in {
        "tfidf": tfidf_scores(asked, posted, terms),
        "bm25": bm25_scores(asked, posted, terms, F.lit(len(DOCS)), F.lit(CORPUS.average)),
    }.items():
        got = {(r.query_id, r.doc_id): r.score for r in scores.collect()}
        for q, words in enumerate([{"quick", "red", "fox"}, {"fox"}, set(), set(), set()]):
            want = {d[0]: getattr(CORPUS, name)(words, d[0]) for d in DOCS}
            assert {d: s for (qq, d), s in got.items() if qq == q} == pytest.approx({d: s for d, s in want.items() if s})


def test_relevance_divides_by_the_best(spark):
    df = spark.createDataFrame([(0, 1, 2.0), (0, 2, 4.0), (1, 1, 0.0)], "query_id int, doc_id int, score double")
    got = {(r.query_id, r.doc_id): r.keyword_relevance for r in keyword_relevance(df).collect()}
    assert got == {(0, 1): 0.5, (0, 2): 1.0, (1, 1): 0.0}


def test_query_terms(spark):
    got = {}
    for r in terms_of(spark, "The fox, the FOX!", "", "and of").collect():
        got.setdefault(r.query_id, []).append(r.term)
    assert got == {0: ["fox"], 1: [""], 2: [""]}


def test_synonym_rules(spark):
    """Tokens of three letters or more, unfiltered; three synsets, not three words."""
    queries = spark.createDataFrame([(0, "The big ox")], "query_id bigint, query string")
    table = spark.createDataFrame(
        [("the", 1, "that one"), ("ox", 1, "bull"), ("big", 1, "large"), ("big", 1, "big"), ("big", 1, "huge"),
         ("big", 2, "tall"), ("big", 3, "vast"), ("big", 4, "grand")],
        "token string, synset_rank int, synonym string",
    )
    expansion = expand_synonyms(queries, table)
    assert {r.expansion for r in expansion.collect()} == {"that one", "large", "huge", "tall", "vast"}
    terms = {r.term for r in query_terms(queries, expansion).collect()}
    assert terms == {"big", "ox", "one", "large", "huge", "tall", "vast"}
