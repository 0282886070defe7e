"""Sales reports over the order-line table.

Input: the order-line table (columns of ``fixtures.ORDER_COLUMNS``) with
``order_date`` as DATE.  Money is summed exactly (decimal) and returned as
DOUBLE; dates leave as 'YYYY-MM-DD' text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.rules import (date_text, effective_sale, js_round, money, month_prune, nonempty)


# ---- filters (F1, F3) -----------------------------------------------------

def in_period(df: DataFrame, start: str, end: str, col: str = "order_date") -> DataFrame:
    """inclusive date range (``BETWEEN``); on the stored table the month
    partitions outside the range are not read."""
    df = month_prune(df, start, end) if col == "order_date" else df
    return df.where(F.col(col).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def before_period(df: DataFrame, base: str, start: str, col: str = "order_date") -> DataFrame:
    """half-open ``[base, start)`` -- movement before a period."""
    c = F.col(col)
    df = month_prune(df, base, start) if col == "order_date" else df
    return df.where((c >= F.lit(base).cast("date")) & (c < F.lit(start).cast("date")))


def for_channel(df: DataFrame, channel: str | None) -> DataFrame:
    """channel equality; ``None``, '' or 'all' means every channel."""
    if not channel or channel == "all":
        return df
    return df.where(F.col("channel") == channel)


def effective(df: DataFrame) -> DataFrame:
    """effective sales only."""
    return df.where(effective_sale("status"))


def _sales(df: DataFrame, start: str, end: str) -> DataFrame:
    return effective(in_period(df, start, end))


def _order_stats(amount_sum, order_cnt):
    """Average order value as the SQL source computes it: ROUND(sum/count),
    0 when there are no orders."""
    return F.when(order_cnt > 0, F.round(amount_sum / order_cnt, 0)).otherwise(F.lit(0)).cast("double")


# ---- aggregates -----------------------------------------------------------

def sales_by_channel(orders: DataFrame, start: str, end: str) -> DataFrame:
    """G1: distinct orders, revenue and rounded average per channel."""
    s = money("amount")
    return (_sales(orders, start, end)
            .groupBy("channel")
            .agg(F.countDistinct("order_id").alias("order_count"), F.sum(s).alias("_sum"))
            .select("channel", "order_count",
                    F.coalesce(F.col("_sum").cast("double"), F.lit(0.0)).alias("total_amount"),
                    _order_stats(F.col("_sum"), F.col("order_count")).alias("avg_order")))


def daily_sales(orders: DataFrame, start: str, end: str, channel: str | None = None) -> DataFrame:
    """Per day and channel: distinct orders and revenue."""
    return (for_channel(_sales(orders, start, end), channel)
            .groupBy("order_date", "channel")
            .agg(F.countDistinct("order_id").alias("order_count"),
                 F.coalesce(F.sum(money("amount")).cast("double"), F.lit(0.0)).alias("total_amount"))
            .select(date_text("order_date").alias("date"), "channel", "order_count", "total_amount"))


def top_products(orders: DataFrame, start: str, end: str, limit: int = 20) -> DataFrame:
    """Quantity, revenue and line count per (name, channel); top ``limit``
    by revenue.  ``order_count`` counts lines, as in the source."""
    agg = (_sales(orders, start, end).where(nonempty("product_name"))
           .groupBy("product_name", "channel")
           .agg(F.sum("quantity").cast("bigint").alias("total_qty"),
                F.sum(money("amount")).cast("double").alias("total_amount"),
                F.count(F.lit(1)).alias("order_count")))
    return agg.orderBy(F.col("total_amount").desc(), "product_name", "channel").limit(limit)


def order_count(orders: DataFrame) -> DataFrame:
    """Distinct orders in the store."""
    return orders.agg(F.countDistinct("order_id").alias("order_count"))


def order_count_by_channel(orders: DataFrame) -> DataFrame:
    """Distinct orders per channel."""
    return orders.groupBy("channel").agg(F.countDistinct("order_id").alias("count"))


def store_stats(orders: DataFrame, inventory: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """One row of store statistics.

    The inputs are tagged and unioned so the whole row comes from one
    aggregate (no one-row joins).
    """
    parts = [
        orders.select("order_id", F.col("order_date"), F.lit(0).alias("_inv"), F.lit(0).alias("_run")),
        inventory.select(F.lit(None).cast("string").alias("order_id"), F.lit(None).cast("date").alias("order_date"),
                         F.lit(1).alias("_inv"), F.lit(0).alias("_run")),
    ]
    if history is not None:
        parts.append(history.select(F.lit(None).cast("string").alias("order_id"),
                                    F.lit(None).cast("date").alias("order_date"),
                                    F.lit(0).alias("_inv"), F.lit(1).alias("_run")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.agg(
        F.countDistinct("order_id").alias("total_orders"),
        date_text(F.min("order_date")).alias("date_from"),
        date_text(F.max("order_date")).alias("date_to"),
        F.sum("_run").cast("bigint").alias("collect_history"),
        F.sum("_inv").cast("bigint").alias("inventory_products"),
    )


def dashboard_daily(orders: DataFrame, start: str, end: str, channels: Sequence[str]) -> DataFrame:
    """Daily revenue pivoted by channel (fixed list, 0 when absent) plus a
    row total."""
    piv = (_sales(orders, start, end)
           .groupBy("order_date")
           .pivot("channel", list(channels))
           .agg(F.sum(money("amount"))))
    cols = [F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c) for c in channels]
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in channels), F.lit(0)).cast("double")
    return piv.select(date_text("order_date").alias("date"), *cols, total.alias("total"))


def dashboard_summary(orders: DataFrame, start: str, end: str) -> DataFrame:
    """Dashboard totals from the per-channel block: revenue, orders, and
    ``Math.round`` average."""
    per = sales_by_channel(orders, start, end)
    return per.agg(F.coalesce(F.sum(money("total_amount")).cast("double"), F.lit(0.0)).alias("total_revenue"),
                   F.coalesce(F.sum("order_count"), F.lit(0)).cast("bigint").alias("total_orders")) \
        .select("total_revenue", "total_orders",
                F.when(F.col("total_orders") > 0, js_round(F.col("total_revenue") / F.col("total_orders")))
                 .otherwise(F.lit(0)).cast("bigint").alias("avg_order_value"))


def daily_summary(orders: DataFrame, channel: str | None = None) -> DataFrame:
    """G26 (query half of K5): per day and channel, **no status filter**."""
    df = for_channel(orders, channel).where(F.col("order_date").isNotNull())
    s = money("amount")
    return (df.groupBy("order_date", "channel")
            .agg(F.countDistinct("order_id").alias("order_count"), F.sum(s).alias("_sum"))
            .select(date_text("order_date").alias("date"), "channel", "order_count",
                    F.col("_sum").cast("double").alias("total_amount"),
                    _order_stats(F.col("_sum"), F.col("order_count")).alias("avg_order")))


def range_counts(orders: DataFrame, start: str, end: str) -> DataFrame:
    """Order and product counts for a date range."""
    return in_period(orders, start, end).agg(
        F.countDistinct("order_id").alias("orders_count"),
        F.countDistinct(F.when(nonempty("product_no"), F.col("product_no"))).alias("products_count"))


# ---- lists ----------------------------------------------------------------

RECENT_COLUMNS = ("id", "channel", "order_id", "order_date", "status", "product_name",
                  "quantity", "amount", "customer", "variant_code")


def recent_orders(orders: DataFrame, limit: int = 50, channel: str | None = None) -> DataFrame:
    """L2: the ``limit`` newest lines (id breaks ties)."""
    n = max(0, int(limit))
    return (for_channel(orders, channel)
            .orderBy(F.col("order_date").desc(), F.col("id"))
            .limit(n)
            .select(*[date_text(c).alias(c) if c == "order_date" else F.col(c) for c in RECENT_COLUMNS]))


def order_by_id(orders: DataFrame, order_id: str) -> DataFrame:
    """All lines of one order."""
    cols = [c for c in orders.columns if c != "order_month"]
    return orders.where(F.col("order_id") == order_id) \
        .select(*[date_text(c).alias(c) if c == "order_date" else F.col(c) for c in cols])
