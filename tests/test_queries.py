"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_point
from check_oracles import compare, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(entry_point.queries()))
def test_query(spark, con, name):
    problem, _, _ = compare(spark, con, FOLDER, name, entry_point.queries(), entry_point.oracle_sql())
    assert problem == ""


def test_entry(spark):
    row = entry_point.entry(spark).first()
    assert row["total_rows"] > 0 and row["passed"]


def test_sql_belongs_to_queries():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
