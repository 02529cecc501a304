"""Registered queries against their SQL, on the smallest tables.

TEST_ALL=1 runs every query; otherwise one in six of each family.
"""

import glob
import os

import duckdb
import pytest
from conftest import SF

import __spark_entry__ as entry_points
from tools.check_oracle import compare

NAMES = list(entry_points.queries())
SHOWN = NAMES if os.environ.get("TEST_ALL") else NAMES[::6]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def test_every_sql_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(NAMES)


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.count() > 0 and "supplier_hhi" in df.columns


@pytest.mark.parametrize("name", SHOWN)
def test_query(spark, con, name):
    df = entry_points.queries()[name](spark, SF)
    sql = entry_points.oracle_sql().get(name)
    if sql is None:
        df.count()
    else:
        result = compare(df, con, sql)
        assert result.startswith("ok"), result
