"""Channel analytics, integrated analytics and period comparison
(G14-G17, G24, G25, J8, L7) over the raw channel feeds.

Each channel feed is first reduced to two uniform frames:

* order rows ``(channel, date, amount, valid)`` -- one per fetched record;
* product rows ``(channel, key, name, quantity, revenue, date)`` -- valid
  records only,

with the channel's own rules (status exclusion, amount fallbacks, quantity
defaults).  All reports are aggregates over these frames; per-channel top
lists use ``row_number`` windows whose ``<= k`` filter Spark turns into a
partial top-k before the shuffle.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.rules import (day_sql, falsy_coalesce, js_rate, js_round, lit_sql, money, or_sql,
                                       parse_float_sql, parse_int_sql)


# ---- per-channel reduction ------------------------------------------------------

_A_VALID = "NOT coalesce(order_status, '') LIKE 'C%' AND NOT coalesce(order_status, '') LIKE 'R%'"


def order_rows_a(raw: DataFrame, channel: str = "A") -> DataFrame:
    """Channel A: amount = payment fallback chain; statuses starting with C
    or R (case-sensitive) are not sales."""
    amt = parse_float_sql(or_sql("payment_amount", "actual_payment_amount", "total_price", default="0"))
    return raw.selectExpr(f"{lit_sql(channel)} AS channel", f"{day_sql('order_date')} AS date",
                          f"coalesce({amt}, 0.0) AS amount", f"{_A_VALID} AS valid")


def product_rows_a(raw: DataFrame, channel: str = "A") -> DataFrame:
    """Channel A items of valid orders: key = product no, else name; item
    quantity defaults to 0; revenue = list price x quantity."""
    v = raw.where(_A_VALID).selectExpr(f"{day_sql('order_date')} AS date", "explode(items) AS it")
    qty = f"coalesce({parse_int_sql(or_sql('it.quantity', default='0'))}, 0)"
    price = f"coalesce({parse_float_sql(or_sql('it.product_price', default='0'))}, 0.0)"
    return v.selectExpr(f"{lit_sql(channel)} AS channel", f"{or_sql('it.product_no', 'it.product_name')} AS key",
                        "it.product_name AS name", f"CAST({qty} AS BIGINT) AS quantity",
                        f"{price} * {qty} AS revenue", "date")


_AMOUNT_B = f"coalesce({parse_float_sql(or_sql('orderPrice', 'totalPrice', default='0'))}, 0.0)"


def order_rows_b(raw: DataFrame, channel: str = "B") -> DataFrame:
    """Channel B: every record is a sale (no status exclusion)."""
    return raw.selectExpr(f"{lit_sql(channel)} AS channel", f"{day_sql('orderedAt', 'createdAt')} AS date",
                          f"{_AMOUNT_B} AS amount", "TRUE AS valid")


def product_rows_b(raw: DataFrame, channel: str = "B") -> DataFrame:
    key = or_sql("vendorItemId", "vendorItemName", default="unknown")
    return raw.selectExpr(f"{lit_sql(channel)} AS channel", f"{key} AS key",
                          f"{or_sql('vendorItemName', key)} AS name",
                          f"coalesce({parse_int_sql(or_sql('shippingCount', default='1'))}, 0) AS quantity",
                          f"{_AMOUNT_B} AS revenue", f"{day_sql('orderedAt', 'createdAt')} AS date")


_C_VALID = "coalesce(search_status, '') NOT IN ('CANCELED', 'RETURNED')"
_AMOUNT_C = (f"coalesce({parse_float_sql(or_sql('totalPaymentAmount', 'paymentAmount', 'totalProductAmount', default='0'))}"
             ", 0.0)")


def order_rows_c(raw: DataFrame, channel: str = "C") -> DataFrame:
    """Channel C: records found under the CANCELED / RETURNED batches are
    not sales."""
    return raw.selectExpr(f"{lit_sql(channel)} AS channel", f"{day_sql('orderDate', 'paymentDate')} AS date",
                          f"{_AMOUNT_C} AS amount", f"{_C_VALID} AS valid")


def product_rows_c(raw: DataFrame, channel: str = "C") -> DataFrame:
    """Channel C: the product key is the line id first, so "products" are
    lines."""
    key = or_sql("productOrderId", "productName", default="unknown")
    return raw.where(_C_VALID).selectExpr(
        f"{lit_sql(channel)} AS channel", f"{key} AS key", f"{or_sql('productName', key)} AS name",
        f"coalesce({parse_int_sql(or_sql('quantity', default='1'))}, 0) AS quantity",
        f"{_AMOUNT_C} AS revenue", f"{day_sql('orderDate', 'paymentDate')} AS date")


def in_window(df: DataFrame, start: str, end: str) -> DataFrame:
    """Records fetched for ``[start, end]`` (both days included)."""
    return df.where(F.col("date").between(start, end))


# ---- channel reports (G14-G16) -------------------------------------------------------

def channel_summary(order_rows: DataFrame) -> DataFrame:
    """Revenue, order count and ``Math.round`` average per channel."""
    agg = order_rows.groupBy("channel").agg(
        F.coalesce(F.sum(F.when(F.col("valid"), money("amount"))), F.lit(0)).alias("_rev"),
        F.count(F.when(F.col("valid"), 1)).alias("order_count"))
    rev = F.col("_rev").cast("double")
    return agg.select("channel", rev.alias("total_revenue"), "order_count",
                      F.when(F.col("order_count") > 0, js_round(rev / F.col("order_count"))).otherwise(F.lit(0))
                       .cast("bigint").alias("avg_order_value"))


def channel_daily(order_rows: DataFrame) -> DataFrame:
    """Revenue per channel and day (valid records with a date)."""
    return (order_rows.where(F.col("valid") & F.col("date").isNotNull())
            .groupBy("channel", "date").agg(F.sum(money("amount")).cast("double").alias("amount")))


def channel_products(product_rows: DataFrame) -> DataFrame:
    """Per channel: quantity and revenue of every product key."""
    return product_rows.groupBy("channel", "key").agg(
        F.min_by("name", F.struct("date", "name")).alias("name"),
        F.sum("quantity").cast("bigint").alias("quantity"),
        F.sum(money("revenue")).cast("double").alias("revenue"))


def channel_top_products(product_rows: DataFrame, k: int = 20) -> DataFrame:
    """Per channel: the top ``k`` products by revenue (ties by key), with rank."""
    agg = channel_products(product_rows)
    w = Window.partitionBy("channel").orderBy(F.col("revenue").desc(), F.col("key"))
    return agg.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


# ---- integrated analytics (G17) ---------------------------------------------------------

def integrated_channels(summary: DataFrame) -> DataFrame:
    """Per channel: revenue, orders, average and share of the grand total
    (``Math.round(x * 1000) / 10``)."""
    # one row per channel: the grand total is a window over them
    total = F.sum(money("total_revenue")).over(Window.partitionBy(F.lit(0)))
    rev = F.col("total_revenue")
    return summary.select("channel", rev.alias("revenue"), F.col("order_count").alias("orders"),
                          F.col("avg_order_value"),
                          F.when(total > 0, js_rate(rev, total)).otherwise(F.lit(0.0)).alias("share_percent"))


def integrated_summary(summary: DataFrame) -> DataFrame:
    """Grand totals over channels: revenue, orders, ``Math.round`` average."""
    agg = summary.agg(F.coalesce(F.sum(money("total_revenue")), F.lit(0)).cast("double").alias("total_revenue"),
                      F.coalesce(F.sum("order_count"), F.lit(0)).cast("bigint").alias("total_orders"))
    return agg.withColumn("avg_order_value",
                          F.when(F.col("total_orders") > 0,
                                 js_round(F.col("total_revenue") / F.col("total_orders"))).otherwise(F.lit(0))
                          .cast("bigint"))


def integrated_daily(daily: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Daily revenue pivoted by channel (0 when absent) plus a total."""
    p = daily.groupBy("date").pivot("channel", list(channels)).agg(F.sum(money("amount")))
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in channels), F.lit(0)).cast("double")
    return p.select("date", *[F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c) for c in channels],
                    total.alias("total"))


def integrated_products(top: DataFrame, channels: Sequence[str], k: int = 30) -> DataFrame:
    """Per-channel products (all of them, or top lists) merged by product
    name: summed quantity and revenue, per-channel revenue columns; top ``k`` by revenue."""
    key = falsy_coalesce(F.col("name"), default="unknown")
    per = [F.sum(F.when(F.col("channel") == c, money("revenue"))).cast("double").alias(f"revenue_{c}")
           for c in channels]
    agg = top.groupBy(key.alias("product_name")).agg(
        F.sum("quantity").cast("bigint").alias("total_qty"),
        F.sum(money("revenue")).cast("double").alias("total_revenue"),
        F.count(F.lit(1)).alias("n_channels"), *per)
    return agg.orderBy(F.col("total_revenue").desc(), "product_name").limit(k)


# ---- J8: period comparison ---------------------------------------------------------------

def comparison_start(as_of: str, days: int = 30) -> str:
    """The first day that ``period_comparison`` reads."""
    return (dt.date.fromisoformat(as_of) - dt.timedelta(days=2 * days)).isoformat()


def period_comparison(order_rows: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Last ``days`` days against the ``days`` before (the boundary day is in
    both windows): totals per window in one pass, then % change (null when
    the previous value is not positive)."""
    d = F.col("date").cast("date")
    end = F.lit(as_of).cast("date")
    start = F.date_sub(end, days)
    prev_start = F.date_sub(end, 2 * days)
    cur = d.between(start, end)
    prev = d.between(prev_start, start)
    v = F.col("valid")
    per_channel = order_rows.where(d.between(prev_start, end)).groupBy("channel").agg(
        F.coalesce(F.sum(F.when(cur & v, money("amount"))), F.lit(0)).alias("cur_rev"),
        F.count(F.when(cur & v, 1)).alias("cur_orders"),
        F.coalesce(F.sum(F.when(prev & v, money("amount"))), F.lit(0)).alias("prev_rev"),
        F.count(F.when(prev & v, 1)).alias("prev_orders"))
    tot = per_channel.agg(F.sum("cur_rev").cast("double").alias("cur_revenue"),
                          F.sum("cur_orders").cast("bigint").alias("cur_orders"),
                          F.sum("prev_rev").cast("double").alias("prev_revenue"),
                          F.sum("prev_orders").cast("bigint").alias("prev_orders"))

    def avg(r, n):
        return F.when(F.col(n) > 0, js_round(F.col(r) / F.col(n))).otherwise(F.lit(0)).cast("bigint")

    tot = tot.withColumn("cur_avg", avg("cur_revenue", "cur_orders")) \
             .withColumn("prev_avg", avg("prev_revenue", "prev_orders"))

    def trend(c, p):
        return F.when(F.col(p) > 0, js_rate(F.col(c) - F.col(p), F.col(p)))

    return tot.select("cur_revenue", "prev_revenue", trend("cur_revenue", "prev_revenue").alias("revenue_trend"),
                      "cur_orders", "prev_orders", trend("cur_orders", "prev_orders").alias("orders_trend"),
                      "cur_avg", "prev_avg", trend("cur_avg", "prev_avg").alias("avg_trend"))


# ---- G24: run totals ------------------------------------------------------------------------

def run_totals(metrics: DataFrame) -> DataFrame:
    """Rows fetched / saved summed over channel metric rows; a failed
    channel counts as 0."""
    ok = F.col("status") == "success"
    return metrics.agg(F.sum(F.when(ok, F.col("count")).otherwise(0)).cast("bigint").alias("total_count"),
                       F.sum(F.when(ok, F.col("saved")).otherwise(0)).cast("bigint").alias("total_saved"),
                       F.count(F.when(~ok, 1)).alias("failed_channels"),
                       F.count(F.lit(1)).alias("channels"))


# ---- G25: funnel, hours, recent-day shares -----------------------------------------------------

def hour_histogram(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Events per hour of day (0-23)."""
    return events.groupBy(F.hour(F.col(ts).cast("timestamp")).cast("bigint").alias("hour")).agg(F.count(F.lit(1)).alias("events"))


def recent_channel_share(orders: DataFrame, as_of: str, windows=(7, 14, 30)) -> DataFrame:
    """Channel revenue over the last n days (n in ``windows``, as-of day
    included) and its share of the n-day total; one pass, stacked."""
    import datetime as _dt
    from ledgerline.functions.rules import effective_sale, month_prune
    d = F.col("order_date")
    end = F.lit(as_of).cast("date")
    longest = max(windows)
    first_day = (_dt.date.fromisoformat(as_of) - _dt.timedelta(days=longest)).isoformat()
    orders = month_prune(orders, first_day, as_of)
    base = orders.where(effective_sale("status") & (d > F.date_sub(end, longest)) & (d <= end))
    sums = [F.sum(F.when(d > F.date_sub(end, n), money("amount"))).alias(f"r{n}") for n in windows]
    per = base.groupBy("channel").agg(*sums)
    stacked = per.select("channel", F.explode(F.array(*[
        F.struct(F.lit(n).alias("days"), F.coalesce(F.col(f"r{n}"), F.lit(0)).alias("rev")) for n in windows]))
        .alias("s")).select("channel", "s.days", "s.rev")
    w = Window.partitionBy("days")
    total = F.sum("rev").over(w)
    return stacked.select("days", "channel", F.col("rev").cast("double").alias("revenue"),
                          F.when(total > 0, js_rate(F.col("rev"), total)).otherwise(F.lit(0.0)).alias("share_percent"))
