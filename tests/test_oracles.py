"""Differential suite: every registered plan against its DuckDB oracle on
the smallest driver tables (the driver repeats this at sf0.01)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from ledgerline.plans import all_plans  # noqa: E402

from fixture_paths import SF_SMALL  # noqa: E402

PLANS = all_plans()


@pytest.fixture(scope="module")
def duck():
    import check_oracles
    return check_oracles.duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(PLANS))
def test_plan_matches_oracle(spark, duck, name):
    import check_oracles
    p = PLANS[name]
    res = check_oracles.compare(spark, duck, name, p.build, p.oracle, SF_SMALL)
    assert res["status"] in ("ok", "no-oracle"), res


def test_entry_contract(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.columns == ["channel", "order_count", "total_amount", "avg_order"]
    assert df.count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())
