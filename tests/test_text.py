from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from lineseek.functions.text import (
    ENGLISH_STOPWORDS,
    content_words,
    join_words,
    normalise,
    remove_stopwords,
    tokenise,
)
from lineseek.operators.lemmas import lemmatise
from lineseek.operators.query import query_terms

TEXTS = {
    "Ünïcode's … naïve_x 3.14": "n code s na ve_x 3 14",
    "  A--B\t\nc  ": "a b c",
    "": "",
    "!?": "",
    "snake_case 42": "snake_case 42",
}


def test_normalise_and_tokenise(spark):
    df = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "t string")
    for text, plain, tokens in df.select("t", normalise(F.col("t")), tokenise(F.col("t"))).collect():
        expected = TEXTS.get(text, "")
        assert plain == expected
        assert tokens == expected.split()


def test_stopwords_are_sparks(spark):
    assert sorted(ENGLISH_STOPWORDS) == sorted(StopWordsRemover.loadDefaultStopWords("english"))


def test_stopword_removal_keeps_order_and_repeats(spark):
    df = spark.createDataFrame([(["the", "cat", "and", "the", "cat", "x"],)], "w array<string>")
    assert df.select(remove_stopwords(F.col("w"))).first()[0] == ["cat", "cat", "x"]


def test_pipeline(spark):
    df = spark.createDataFrame([("The Cats, and the DOGS!",), (None,), ("of the",)], "t string")
    assert [r[0] for r in df.select(join_words(content_words(F.col("t")))).collect()] == ["cats dogs", "", ""]


def test_lemmas(spark):
    rows = [(1, ["cats", "run", "cats", "ran"]), (2, []), (3, ["mice"]), (4, ["zz", "ran"]), (5, None), (1, ["ran"]), (1, ["ran"])]
    df = spark.createDataFrame(rows, "doc_id bigint, words array<string>").repartition(3)
    table = spark.createDataFrame(
        [("cats", "cat"), ("ran", "run"), ("mice", "mouse"), ("cats", "dog"), (None, "x"), ("run", None)],
        "token string, lemma string",
    )
    lemma = {"cats": "cat", "ran": "run", "mice": "mouse"}
    want = sorted((i, [lemma.get(word, word) for word in words or []]) for i, words in rows)
    got = lemmatise(df, "words", table)
    assert got.columns == df.columns
    assert sorted((r.doc_id, r.words) for r in got.collect()) == want
    assert lemmatise(df, "words") is df


def test_lemmas_of_terms_keep_repeated_queries_apart(spark):
    queries = spark.createDataFrame([(1, "cats and dogs"), (2, "cats")], "query_id bigint, query string")
    expansions = spark.createDataFrame([(1, "mice"), (1, "near cats"), (2, "cats")], "query_id bigint, expansion string")
    table = spark.createDataFrame([("cats", "cat"), ("mice", "mouse")], "token string, lemma string")
    got = {(r.query_id, r.term) for r in query_terms(queries, expansions, table).collect()}
    assert got == {(1, "cat"), (1, "dogs"), (1, "mouse"), (1, "near"), (2, "cat")}
