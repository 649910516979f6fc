"""Every registered query against its SQL on the given tables."""

import duckdb
import pytest

import __spark_entry__ as entry_point
import workloads
from tools.check_queries import NAMES, bag

QUERIES = workloads.all_queries()
SQL = workloads.all_sql()


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for name in NAMES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    found = db.execute(SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert bag(df.columns, df.collect()) == bag(columns, found.fetchall())


def test_entry(spark):
    assert entry_point.entry(spark).columns == ["o_orderkey", "o_totalprice", "c_name"]
    assert QUERIES.keys() <= entry_point.queries().keys()
