"""Every registered query with a SQL twin equals it on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracle import TABLES, compare
from conftest import SF

ORACLE = oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    assert compare(queries()[name](spark, SF), con.execute(ORACLE[name])) == ""


def test_registry_is_consistent():
    assert set(ORACLE) <= set(queries()) and len(queries()) > 170


def test_entry(spark):
    assert entry(spark).count() == 1
