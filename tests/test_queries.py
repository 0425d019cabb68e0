"""Every registered event-log query against its SQL on DuckDB, over sf0.001."""

import glob
import os

import duckdb
import pytest

from rangeweave.plans import catalog

DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, rows, name):
    found = QUERIES[name](spark, DIR)
    got = [r.asDict() for r in found.collect()]
    if name not in ORACLES:
        assert found.columns and got
        return
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    want = [dict(zip(columns, r)) for r in cursor.fetchall()]
    assert sorted(columns) == sorted(found.columns)
    assert rows(got, sorted(columns)) == rows(want, sorted(columns))


def test_all_segment_files_are_read_back(spark):
    found = QUERIES["s11_all_segment_files"](spark, DIR).collect()
    assert {r.range_id for r in found} == {r.range_id for r in QUERIES["r1_segment_rolls"](spark, DIR).select("range_id").distinct().collect()}
    assert min(r.segment_id for r in found) == 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["range_id", "records", "bytes", "next_entry_id"]
