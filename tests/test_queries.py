"""Every registered query at the smallest scale, beside its SQL where it has some."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from check_oracle import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", entry_points.queries())
def test_query(spark, con, name):
    result = compare(spark, con, name, SF)
    assert " ok " in result or "rows only" in result, result


def test_entry(spark):
    assert entry_points.entry(spark).count() == 11


def test_oracles_have_queries():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
