"""Every registered query against its oracle at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import check_oracle

FOLDER = "/root/testdata/sf0.001"
FITTED = ("a11_fit_", "a11_predict", "a11_confidence", "a11_importance", "a17_", "m_")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in check_oracle.TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def test_oracle_and_queries_have_the_same_names():
    without = {q for q in entry.queries() if q not in entry.oracle_sql()}
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(q.startswith((*FITTED, "op", "pipeline")) for q in without)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    found = check_oracle.table([tuple(r) for r in df.collect()], df.columns)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    expected = check_oracle.table(result.fetchall(), columns)
    assert found[0] == expected[0]
    assert found[1] == expected[1]


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
