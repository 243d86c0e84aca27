"""Every registered query against its SQL on the smallest tables, and the entry point."""

import os

import pytest

import __spark_entry__ as entry
from check_queries import compare, open_tables

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# fits with more terms than the ten tests of the smallest tables
NEEDS_MORE_TESTS = {"d2b_ols_terms", "d5_regression_rows", "d7b_adjusted_means_cluster",
                    "d8_adjusted_curve"}
QUERIES, SQL = entry.queries(), entry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return open_tables(SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - NEEDS_MORE_TESTS))
def test_query(spark, con, name):
    status, detail, *_ = compare(spark, con, SF, name, QUERIES[name], SQL.get(name))
    assert status in ("ok", "rows"), detail


def test_entry(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert rows and all(r.corrected is not None and r.status == "ok" for r in rows)
    assert {"test_id", "naive", "corrected", "bias"} <= set(df.columns)


def test_sql_only_for_registered_queries():
    assert set(SQL) <= set(QUERIES)
