import duckdb
import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries
from pairforge.checks.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in check.TABLES:
        connection.execute(f"CREATE VIEW {name} AS FROM '{SMALL}/{name}.parquet'")
    return connection


def test_every_query_has_a_twin():
    assert set(QUERIES) <= set(queries())
    assert set(QUERIES) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_twin(spark, duck, name):
    got = queries()[name](spark, SMALL)
    want = duck.execute(oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert check.rows(got.columns, got.collect()) == check.rows(columns, want.fetchall())


def test_entry(spark):
    assert entry(spark).count() > 0
