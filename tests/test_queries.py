"""Registered queries against their SQL on the smallest test tables."""

import os
import re

import pytest

import __spark_entry__ as contract
from checks.compare import connect, differences
from checks.oracle import ORACLE_SQL
from checks.registry import QUERIES

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(contract.queries())
    assert set(ORACLE_SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    df = contract.queries()[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # No Python in any plan, no all-pairs join, no window over one partition.
    assert not re.search(r"Python|Pandas|CartesianProduct|BroadcastNestedLoopJoin", plan)
    assert not ("Window" in plan and "Exchange SinglePartition" in plan)
    assert differences(df.toPandas(), con.execute(contract.oracle_sql()[name]).df()) is None


# Queries with ordered work inside groups, again with the segmented plans.
HOT = [
    "hardness_fill",
    "thermocline",
    "chronic_events",
    "ammonia_acute",
    "ammonia_chronic_standard",
    "ammonia_first_last",
    "tsi_nvss",
    "tsi_use_support",
]


@pytest.mark.parametrize("name", HOT)
def test_huge_sites_give_the_same_result(spark, con, small_limit, name):
    ours = contract.queries()[name](spark, SF_DIR).toPandas()
    assert differences(ours, con.execute(contract.oracle_sql()[name]).df()) is None


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_row_ids_tell_lines_apart(con):
    """One pair of lines shares an id in this folder, none in the larger ones."""
    number = "(l_orderkey * 8 + l_linenumber) * 1048576 + (l_partkey * 7919 + l_suppkey) % 1048576"
    rows, ids = con.execute(f"SELECT count(*), count(DISTINCT {number}) FROM lineitem").fetchone()
    assert rows - ids == 1
