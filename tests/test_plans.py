"""Plan-shape checks for the scale properties the README claims."""

import os

import pytest

from lacuna.plans.registry_more import QUERIES
from lacuna.sources import testdata as TD

from conftest import SF_SMALL

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="driver test data not present")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_cube_pushes_filters_prunes_columns_and_aggregates_partially(spark):
    df = TD.order_cube(spark, SF_SMALL)
    formatted = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "EqualTo(l_returnflag,R)" in formatted and "EqualTo(l_linestatus,F)" in formatted
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_returnflag:string,l_linestatus:string>" in formatted
    assert "ReadSchema: struct<c_custkey:bigint,c_nationkey:int,c_mktsegment:string>" in formatted
    plan = _plan(df)
    # lines per order, orders per (customer, year, status, priority), final cube: all partial before the shuffle
    assert plan.count("partial_sum") >= 3
    assert "CartesianProduct" not in plan


def test_no_cartesian_products_in_registered_queries(spark):
    for name, (fn, _) in QUERIES.items():
        plan = _plan(fn(spark, SF_SMALL))
        assert "CartesianProduct" not in plan, name


def test_related_uses_partial_top_k(spark):
    plan = _plan(QUERIES["j11_related_crises"][0](spark, SF_SMALL))
    assert "WindowGroupLimit" in plan and "Partial" in plan
