"""Registered sales plans (G1-G7, G26, G27, L2, J9, F1-F3, K1/K2 results)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions.rules import effective_sale
from ledgerline.operators import sales
from ledgerline.plans.params import (EFF_SQL, SALES_END, SALES_START, SALES_WHERE, STOCK_BASE,
                                     STOCK_START, js_round_sql, money_sum_sql)
from ledgerline.plans.registry import plan
from ledgerline.sources import fixtures as fx
from ledgerline.sources.fixtures import CHANNELS, with_views

S, E = SALES_START, SALES_END
AMT = money_sum_sql("amount")
AVG_SQL = ("CAST(CASE WHEN COUNT(DISTINCT order_id) > 0 THEN ROUND(SUM(CAST(amount AS DECIMAL(18,2))) "
           "/ COUNT(DISTINCT order_id), 0) ELSE 0 END AS DOUBLE)")


@plan("g01_sales_by_channel", headline=True, oracle=with_views(["fx_orders"], f"""
SELECT channel, COUNT(DISTINCT order_id) AS order_count, COALESCE({AMT}, 0) AS total_amount, {AVG_SQL} AS avg_order
FROM fx_orders WHERE {SALES_WHERE} GROUP BY channel"""))
def g01(spark, sf):
    return sales.sales_by_channel(fx.orders_table(spark, sf), S, E)


@plan("g02_daily_sales", headline=True, oracle=with_views(["fx_orders"], f"""
SELECT CAST(order_date AS VARCHAR) AS date, channel, COUNT(DISTINCT order_id) AS order_count, COALESCE({AMT}, 0) AS total_amount
FROM fx_orders WHERE {SALES_WHERE} GROUP BY order_date, channel"""))
def g02(spark, sf):
    return sales.daily_sales(fx.orders_table(spark, sf), S, E)


@plan("f03_daily_sales_one_channel", oracle=with_views(["fx_orders"], f"""
SELECT CAST(order_date AS VARCHAR) AS date, channel, COUNT(DISTINCT order_id) AS order_count, COALESCE({AMT}, 0) AS total_amount
FROM fx_orders WHERE {SALES_WHERE} AND channel = 'mall' GROUP BY order_date, channel"""))
def f03(spark, sf):
    return sales.daily_sales(fx.orders_table(spark, sf), S, E, channel="mall")


@plan("g03_top_products", headline=True, oracle=with_views(["fx_orders"], f"""
SELECT product_name, channel, CAST(SUM(quantity) AS BIGINT) AS total_qty, {AMT} AS total_amount, COUNT(*) AS order_count
FROM fx_orders WHERE {SALES_WHERE} AND product_name <> '' GROUP BY product_name, channel
ORDER BY total_amount DESC, product_name, channel LIMIT 20"""))
def g03(spark, sf):
    return sales.top_products(fx.orders_table(spark, sf), S, E, 20)


@plan("g04_order_count", oracle=with_views(["fx_orders"], """
SELECT COUNT(DISTINCT order_id) AS order_count FROM fx_orders"""))
def g04(spark, sf):
    return sales.order_count(fx.orders_table(spark, sf))


@plan("g05_orders_by_channel", oracle=with_views(["fx_orders"], """
SELECT channel, COUNT(DISTINCT order_id) AS count FROM fx_orders GROUP BY channel"""))
def g05(spark, sf):
    return sales.order_count_by_channel(fx.orders_table(spark, sf))


@plan("g06_store_stats", oracle=with_views(["fx_orders", "fx_inventory"], """
SELECT (SELECT COUNT(DISTINCT order_id) FROM fx_orders) AS total_orders,
  (SELECT CAST(MIN(order_date) AS VARCHAR) FROM fx_orders) AS date_from,
  (SELECT CAST(MAX(order_date) AS VARCHAR) FROM fx_orders) AS date_to,
  CAST(0 AS BIGINT) AS collect_history,
  (SELECT COUNT(*) FROM fx_inventory) AS inventory_products"""))
def g06(spark, sf):
    return sales.store_stats(fx.orders_table(spark, sf), fx.inventory(spark, sf))


_PIVOT_SQL = ",\n  ".join(
    f"COALESCE(CAST(SUM(CASE WHEN channel = '{c}' THEN CAST(amount AS DECIMAL(18,2)) END) AS DOUBLE), 0) AS {c}"
    for c in CHANNELS)


@plan("g07_dashboard_daily", headline=True, oracle=with_views(["fx_orders"], f"""
SELECT CAST(order_date AS VARCHAR) AS date,
  {_PIVOT_SQL},
  COALESCE({AMT}, 0) AS total
FROM fx_orders WHERE {SALES_WHERE} GROUP BY order_date"""))
def g07_daily(spark, sf):
    return sales.dashboard_daily(fx.orders_table(spark, sf), S, E, CHANNELS)


@plan("g07_dashboard_summary", oracle=with_views(["fx_orders"], f"""
SELECT total_revenue, total_orders,
  CAST(CASE WHEN total_orders > 0 THEN {js_round_sql('total_revenue / total_orders')} ELSE 0 END AS BIGINT) AS avg_order_value
FROM (SELECT COALESCE(CAST(SUM(CAST(t AS DECIMAL(18,2))) AS DOUBLE), 0) AS total_revenue,
             CAST(COALESCE(SUM(c), 0) AS BIGINT) AS total_orders
      FROM (SELECT channel, COUNT(DISTINCT order_id) AS c, COALESCE({AMT}, 0) AS t
            FROM fx_orders WHERE {SALES_WHERE} GROUP BY channel) per) tot"""))
def g07_summary(spark, sf):
    return sales.dashboard_summary(fx.orders_table(spark, sf), S, E)


@plan("g26_daily_summary", oracle=with_views(["fx_orders"], f"""
SELECT CAST(order_date AS VARCHAR) AS date, channel, COUNT(DISTINCT order_id) AS order_count,
  {AMT} AS total_amount, {AVG_SQL} AS avg_order
FROM fx_orders WHERE order_date IS NOT NULL GROUP BY order_date, channel"""))
def g26(spark, sf):
    return sales.daily_summary(fx.orders_table(spark, sf))


@plan("g27_range_counts", oracle=with_views(["fx_orders"], f"""
SELECT COUNT(DISTINCT order_id) AS orders_count,
  COUNT(DISTINCT CASE WHEN product_no <> '' THEN product_no END) AS products_count
FROM fx_orders WHERE order_date BETWEEN DATE '{S}' AND DATE '{E}'"""))
def g27(spark, sf):
    return sales.range_counts(fx.orders_table(spark, sf), S, E)


@plan("l02_recent_orders", oracle=with_views(["fx_orders"], """
SELECT id, channel, order_id, CAST(order_date AS VARCHAR) AS order_date, status, product_name, quantity, amount, customer, variant_code
FROM fx_orders ORDER BY fx_orders.order_date DESC, id LIMIT 50"""))
def l02(spark, sf):
    return sales.recent_orders(fx.orders_table(spark, sf), 50)


@plan("j09_order_by_id", oracle=with_views(["fx_orders"], """
SELECT id, channel, order_id, CAST(order_date AS VARCHAR) AS order_date, status, product_name, product_no,
  variant_code, quantity, amount, customer
FROM fx_orders WHERE order_id = '3'"""))
def j09(spark, sf):
    return sales.order_by_id(fx.orders_table(spark, sf), "3")


@plan("f01_period_filters", oracle=with_views(["fx_orders"], f"""
SELECT channel,
  COUNT(CASE WHEN order_date BETWEEN DATE '{S}' AND DATE '{E}' THEN 1 END) AS lines_in_period,
  COUNT(CASE WHEN order_date >= DATE '{STOCK_BASE}' AND order_date < DATE '{STOCK_START}' THEN 1 END) AS lines_before
FROM fx_orders GROUP BY channel"""))
def f01(spark, sf):
    o = fx.orders_table(spark, sf)
    counted = lambda df, inside, before: df.groupBy("channel").agg(
        (F.count(F.lit(1)) * inside).alias("i"), (F.count(F.lit(1)) * before).alias("b"))
    every = (counted(o, 0, 0).unionByName(counted(sales.in_period(o, S, E), 1, 0))
             .unionByName(counted(sales.before_period(o, STOCK_BASE, STOCK_START), 0, 1)))
    return every.groupBy("channel").agg(F.sum("i").alias("lines_in_period"), F.sum("b").alias("lines_before"))


@plan("f02_effective_status", oracle=with_views(["fx_orders"], f"""
SELECT status, COUNT(*) AS lines, ({EFF_SQL}) AS effective FROM fx_orders GROUP BY status"""))
def f02(spark, sf):
    return fx.orders_table(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("lines")) \
        .withColumn("effective", effective_sale("status"))


@plan("k01_order_upsert", headline=True, oracle=with_views(["fx_orders"], """
SELECT id, channel, order_id, CAST(order_date AS VARCHAR) AS order_date, status, product_name, product_no,
  variant_code, quantity, amount, customer FROM fx_orders"""))
def k01(spark, sf):
    o = fx.upsert_lines(spark, sf)
    return o.withColumn("order_date", F.col("order_date").cast("string"))


@plan("k02_stock_replace", oracle=with_views(["fx_inventory"], """
SELECT product_code, barcode, product_name, option_name, category, supplier, supplier_option, cost_price,
  sell_price, stock_qty, defect_qty, CAST(base_date AS VARCHAR) AS base_date FROM fx_inventory"""))
def k02(spark, sf):
    return fx.replace_stock(spark, sf).drop("seq").withColumn("base_date", F.col("base_date").cast("string"))
