"""Every query with a SQL counterpart gives the same rows on Spark and DuckDB (smallest scale)."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import check_oracle  # noqa: E402
from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return check_oracle.connect(SF)


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, con, name):
    df = queries()[name](spark, SF)
    result = con.execute(oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert check_oracle.rows_of(df.columns, df.collect()) == check_oracle.rows_of(columns, result.fetchall())


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0 and "brier_corrected" in df.columns
