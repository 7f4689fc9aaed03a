"""Every registered query against its SQL, on the smallest data folder."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_file

SF = "/root/testdata/sf0.001"
QUERIES = entry_file.queries()
ORACLES = entry_file.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def ordered(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = ordered(df.columns, [tuple(r) for r in df.collect()])
    cursor = db.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert got == ordered(names, cursor.fetchall())


def test_workload_is_checked_whole():
    from workload.oracles import ORACLES as own_sql
    from workload.queries import QUERIES as own

    assert set(own) == set(own_sql) and set(own) <= set(QUERIES)


def test_entry(spark):
    assert entry_file.entry(spark).count() == 3
