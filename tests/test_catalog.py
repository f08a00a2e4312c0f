"""Every registered query against its SQL on the smallest supplied tables."""

import datetime

import duckdb
import pytest

from poolscope import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def plain(value):
    return round(value, 9) if isinstance(value, float) else value.isoformat() if isinstance(value, datetime.datetime) else value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([plain(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    if name in catalog.oracle_sql():
        result = duck.execute(catalog.oracle_sql()[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(df.columns)
        assert got == rows_of(names, result.fetchall())
    else:
        assert got


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 100
    assert set(entry.oracle_sql()) <= set(entry.queries())
