"""Registered queries against DuckDB, and the pipeline against a plain version of each stage."""

import re

import pytest

import corpus_pipeline
from checks.compare import duck, normal_rows
from lineseek.llm.oracle import ORACLE
from lineseek.llm.queries import QUERIES

from test_near_dup import brute as near_brute
from test_near_dup import lowered


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_against_sql(spark, data, name):
    connection = duck(data)
    got = QUERIES[name](spark, data)
    want = connection.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = [tuple(row) for row in got.collect()]
    assert normal_rows(got.columns, rows) == normal_rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_covers_its_table(spark, data, name):
    documents = spark.read.parquet(f"{data}/documents.parquet")
    got = QUERIES[name](spark, data)
    assert got.select("doc_id").distinct().count() == documents.count()


def test_pipeline_stages(spark, data):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    extra = spark.createDataFrame(
        [(90_001, "1234 ...", "en", "src0", 8), (90_002, None, None, None, None), (90_003, docs.first().text.upper(), "en", "src1", 1)],
        docs.schema,
    )
    docs = docs.unionByName(extra)
    rows = {row.doc_id: row.text for row in docs.collect()}

    identified = stages["language_id"](spark, docs, data)
    assert identified.columns == docs.columns
    kept = {row.doc_id: row.text for row in identified.collect()}
    assert kept == {i: text for i, text in rows.items() if text and re.search(r"[^\W\d_]", text)}

    single = {row.doc_id: row.text for row in stages["exact_dedup"](spark, identified, data).collect()}
    last = {}
    for doc_id in sorted(kept):
        last[lowered(kept[doc_id])] = doc_id
    assert set(single) == set(last.values())

    docs = spark.createDataFrame([(i, text, "en", "s", 1) for i, text in single.items()], docs.schema)
    near = {row.doc_id for row in stages["near_dedup"](spark, docs, data).collect()}
    _, roots = near_brute(list(single.items()), 5)
    assert near == set(roots.values())


def test_pipeline_runs(spark, data):
    packed = corpus_pipeline.run(spark, data)
    assert packed.count() > 0 and {"doc_id", "sequence_id", "offset", "length"} <= set(packed.columns)
