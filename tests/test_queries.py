"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from rankframe import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Checked against brute force in test_kept.py.
ROWS_ONLY: set[str] = {"f21_pool_latent"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.sql("SET TimeZone = 'UTC'")
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    return repr(value)


def test_only_known_queries_lack_sql():
    assert set(plans.queries()) - set(plans.oracles()) == ROWS_ONLY


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    if name in ROWS_ONLY:
        assert rows
        return
    result = duck.sql(plans.oracles()[name])
    assert sorted(result.columns) == columns
    assert rows == sorted(tuple(plain(r[result.columns.index(c)]) for c in columns) for r in result.fetchall())
