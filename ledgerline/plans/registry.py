"""Registry of named report plans: Spark builder + DuckDB oracle SQL.

Each plan is ``(spark, sf_dir) -> DataFrame`` over the driver tables; the
oracle is ANSI SQL over the same tables (views built with
``fixtures.with_views``).  Plans without an SQL equivalent register
``oracle=None`` and are checked against a brute-force fixture in tests.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Plan:
    name: str
    build: Builder
    oracle: str | None
    headline: bool = False


PLANS: dict[str, Plan] = {}


def plan(name: str, oracle: str | None = None, headline: bool = False):
    def deco(fn: Builder) -> Builder:
        if name in PLANS:
            raise ValueError(f"duplicate plan {name}")
        PLANS[name] = Plan(name, fn, oracle, headline)
        return fn
    return deco
