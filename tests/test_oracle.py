"""Every query with checking SQL gives the same rows, names and types as DuckDB."""

import pytest
from oracle import connect, difference

import __spark_entry__ as entry_points

QUERIES, CHECKS = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_same_rows(spark, con, folder, name):
    assert difference(spark, con, QUERIES[name], CHECKS[name], folder) is None


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(QUERIES)


def test_entry(spark):
    rows = {r["column_name"]: r["missing_count"] for r in entry_points.entry(spark).collect()}
    assert rows["event_type"] > 0 and rows["event_id"] == 0


def test_plans_have_no_cross_join_and_no_python(spark, folder):
    """Checked on the optimised plans, without running the queries a second time."""
    for name in ("outliers_zscore", "histogram", "impute_mean", "impute_mode", "scatter_density", "overview"):
        plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python"):
            assert bad not in plan, (name, bad)
