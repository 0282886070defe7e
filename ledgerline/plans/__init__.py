"""Named report plans and their SQL oracles."""

from ledgerline.plans.registry import PLANS, Plan, plan
from ledgerline.plans import (analytics_plans, collect_plans, ingest_plans, margin_plans, sales_plans,  # noqa: F401
                              sink_plans, stock_plans, stream_plans)


def all_plans() -> dict[str, Plan]:
    return dict(PLANS)
