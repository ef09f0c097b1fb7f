"""Every registered query against its DuckDB statement on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import TABLES, rows_of

SMALL = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    return connection


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    frame = QUERIES[name](spark, SMALL)
    rows = [tuple(r) for r in frame.collect()]
    if name not in ORACLES:
        assert rows
        return
    relation = db.sql(ORACLES[name])
    columns = relation.columns
    assert sorted(columns) == sorted(frame.columns)
    assert rows_of(frame.columns, rows) == rows_of(columns, relation.fetchall())
