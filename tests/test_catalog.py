"""Every registered query against its SQL, on whole test tables."""

import os

import pytest
from compare import difference, engine

import __spark_entry__ as spark_entry

FOLDER = "/root/testdata/" + os.environ.get("CREDITLOOM_TEST_SF", "sf0.001")
QUERIES, SQL = spark_entry.queries(), spark_entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return engine(FOLDER)


def test_entry_gives_rows(spark):
    df = spark_entry.entry(spark)
    assert df.count() == 150
    assert len(df.columns) == 26 + 36


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    assert difference(duck, QUERIES[name](spark, FOLDER), SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_fitted_query_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
