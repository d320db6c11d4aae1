"""Every registered query of the engine against its DuckDB SQL, on the driver's tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from veilstream.plans.queries import ORACLES, QUERIES
from veilstream.streaming.queries import STREAM_ORACLES, STREAMS

SF = "/root/testdata/sf0.001"
ALL, SQL = QUERIES | STREAMS, ORACLES | STREAM_ORACLES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return tuple(map(plain, value)) if isinstance(value, list | tuple) else value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got = ALL[name](spark, SF)
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_queries_without_sql_give_rows(spark, name):
    assert ALL[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(ALL) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
