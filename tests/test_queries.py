"""Every registered query against its SQL on the smallest test tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry_points
from checks import compare

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    return compare.duck(SF_DIR)


@pytest.mark.parametrize("name", compare.QUERIES)
def test_query_equals_sql(spark, connection, name):
    ok, note = compare.compare(spark, connection, SF_DIR, name)
    assert ok, note


def test_oracle_names_are_queries():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert set(compare.QUERIES) - set(compare.ORACLE) == set(compare.PROPERTIES)
    assert set(compare.QUERIES) <= set(entry_points.queries())


def test_entry(spark):
    found = entry_points.entry(spark)
    assert found.columns == ["query_id", "rank", "id", "score", "relevance"]
    assert found.count() > 0
