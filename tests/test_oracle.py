"""Every query against its SQL on the smallest tables, and the driver contract."""

import os

import pytest

import __spark_entry__ as entry_module
from riskloom.checks import all_queries, all_sql
from riskloom.checks.compare import compare, duck

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(all_queries()))
def test_query(spark, con, name):
    result = compare(spark, SF, name, con)
    assert result["problem"] in (None, "no rows")


def test_contract(spark):
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert set(all_queries()) <= set(entry_module.queries())
    assert len(all_queries()) - len(all_sql()) <= 4
    assert entry_module.entry(spark).columns == ["repo", "title", "n", "position"]
    assert entry_module.entry(spark).count() > 0
