"""Every query that SQL can say, against DuckDB on the smallest tables; the others must run."""

import os

import pandas
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    import duckdb

    db = duckdb.connect()
    db.sql("set timezone = 'UTC'")
    for f in os.listdir(data):
        db.sql(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    return db


def canonical(frame):
    def value(v):
        if v is None or pandas.isna(v):
            return "null"
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    frame = frame.reindex(sorted(frame.columns), axis=1).astype(object)
    return list(frame.columns), sorted(tuple(map(value, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, data, duck, name):
    assert canonical(QUERIES[name](spark, data).toPandas()) == canonical(duck.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() >= 0


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0
