"""Every query of the cost library next to its independent SQL."""

import re

import pytest

import __spark_entry__ as entry_points
from checks.compare import difference, duckdb_views
from checks.oracle import ORACLE
from checks.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duckdb_views(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLE) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # No cross joins, and nothing leaves the JVM.
    assert not re.search("CartesianProduct|NestedLoopJoin|EvalPython|InPandas|InArrow", plan)
    assert difference(df, con, name) is None


def test_entry(spark):
    assert entry_points.entry(spark).count() == 6
