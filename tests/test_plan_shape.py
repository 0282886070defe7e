"""Plan checks: filters reach the scan, no Python UDFs, no Cartesian
products in the registered plans."""

import pytest

from ledgerline.plans import all_plans

from fixture_paths import SF_SMALL

P = all_plans()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sales_filter_pushed_to_scan(spark):
    from ledgerline.sources import fixtures as fx
    fx.orders_table(spark, SF_SMALL)
    plan = _plan(P["g01_sales_by_channel"].build(spark, SF_SMALL))
    assert "PushedFilters" in plan and "order_date" in plan.split("PushedFilters")[1][:400]


@pytest.mark.parametrize("name", sorted(P))
def test_no_python_udf_or_cartesian(spark, name):
    plan = _plan(P[name].build(spark, SF_SMALL))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan, f"{name}: {bad}"
