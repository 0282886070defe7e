"""Registered ingest plans: feeds -> order lines (S1-S4, P1-P6, P12, L4, U1-U3,
K1 on normalised lines)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions.rules import last_wins
from ledgerline.operators import normalize as nz
from ledgerline.operators import stock
from ledgerline.plans.registry import plan
from ledgerline.sources import feeds
from ledgerline.sources.fixtures import with_views

OUT = ("id, channel, order_id, CAST(order_date AS VARCHAR) AS order_date, status, product_name, product_no, "
       "variant_code, quantity, amount, customer")

# channel A: items from the upserted 'mall' lines, in line order
_A_LINES = """
SELECT order_id, CAST(split_part(id, '_', 3) AS INT) AS l, product_no, product_name,
  CASE WHEN CAST(split_part(id, '_', 3) AS INT) = 3 THEN 'CV' || product_no ELSE variant_code END AS variant_code,
  CASE WHEN CAST(split_part(id, '_', 3) AS INT) = 5 THEN 1 ELSE quantity END AS q,
  CASE WHEN CAST(split_part(id, '_', 3) AS INT) = 5 THEN 0 ELSE quantity END AS q0,
  floor(amount / quantity + 0.5) AS price, status
FROM fx_orders WHERE channel = 'mall'"""
_A_ORDERS = """
SELECT o_orderkey AS okey, CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_orderdate AS DATE) AS order_date, c_name AS customer,
  CAST(floor(o_totalprice + 0.5) AS DOUBLE) AS pay
FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 3 = 0"""
_A_AGG = """
SELECT order_id, COUNT(*) AS n, SUM(price * q) AS isum, SUM(q) AS qsum, arg_min(status, l) AS first_status,
  arg_min(product_name, l) AS first_name, string_agg(product_name, ', ' ORDER BY l) AS names_comma,
  string_agg(product_name, '/' ORDER BY l) AS names_slash
FROM a_lines GROUP BY order_id"""
_A_OUT = """
SELECT 'A_' || o.order_id || '_' || CAST(row_number() OVER (PARTITION BY o.order_id ORDER BY l.l) - 1 AS VARCHAR) AS id,
  'A' AS channel, o.order_id, o.order_date, g.first_status AS status, l.product_name, l.product_no, l.variant_code,
  CAST(l.q AS BIGINT) AS quantity,
  CAST(floor(o.pay * ((l.price * l.q) / g.isum) + 0.5) AS DOUBLE) AS amount, o.customer
FROM a_orders o JOIN a_agg g ON g.order_id = o.order_id JOIN a_lines l ON l.order_id = o.order_id WHERE g.n > 1
UNION ALL
SELECT 'A_' || o.order_id, 'A', o.order_id, o.order_date, COALESCE(g.first_status, 'N10'),
  COALESCE(l.product_name, ''), COALESCE(l.product_no, ''), COALESCE(l.variant_code, ''),
  CAST(COALESCE(NULLIF(l.q, 0), 1) AS BIGINT), o.pay, o.customer
FROM a_orders o LEFT JOIN a_agg g ON g.order_id = o.order_id LEFT JOIN a_lines l ON l.order_id = o.order_id
WHERE COALESCE(g.n, 0) <= 1"""
_A_RAW = """
SELECT o.okey, o.order_id, CAST(o.order_date AS VARCHAR) AS date, o.pay, COALESCE(g.first_status, 'N10') AS status,
  COALESCE(g.n, 0) AS n, COALESCE(g.qsum, 0) AS qsum, g.first_name, g.names_comma, g.names_slash, o.customer,
  CASE WHEN o.okey % 11 = 0 THEN 0.0 ELSE o.pay END AS page_amount
FROM a_orders o LEFT JOIN a_agg g ON g.order_id = o.order_id"""
A_VIEWS = [("a_lines", _A_LINES), ("a_orders", _A_ORDERS), ("a_agg", _A_AGG), ("a_out", _A_OUT), ("a_raw", _A_RAW)]


def _a_lines(spark, sf):
    raw = feeds.landed_a(spark, sf)
    return nz.normalize_a(raw)


def _out(df):
    return df.select(*[F.col(c).cast("string").alias(c) if c == "order_date" else F.col(c) for c in nz.LINE_COLUMNS])


@plan("s01_channel_a_lines", headline=True, oracle=with_views(["fx_orders"], f"SELECT {OUT} FROM a_out", A_VIEWS))
def s01(spark, sf):
    return _out(_a_lines(spark, sf))


@plan("p02_payment_split", oracle=with_views(["fx_orders"], """
SELECT o.order_id, g.n AS items, o.pay AS payment, CAST(SUM(a.amount) AS DOUBLE) AS allocated,
  abs(SUM(a.amount) - o.pay) <= g.n / 2.0 AS within_bound
FROM a_out a JOIN a_orders o ON o.order_id = a.order_id JOIN a_agg g ON g.order_id = o.order_id
WHERE g.n > 1 GROUP BY o.order_id, g.n, o.pay""", A_VIEWS))
def p02(spark, sf):
    """P2 invariant per multi-item order: the rounded shares add up to the
    payment within n/2."""
    raw = feeds.landed_a(spark, sf)
    n = F.size("items")
    pay = F.col("payment_amount")
    orders = raw.where(n > 1).select("order_id", n.cast("bigint").alias("items"),
                                     F.coalesce(F.nullif(pay, F.lit("")), F.nullif("actual_payment_amount", F.lit("")),
                                                F.col("total_price")).cast("double").alias("payment"))
    lines = nz.normalize_a(raw).groupBy("order_id").agg(F.sum("amount").alias("allocated"))
    j = orders.join(lines, "order_id")
    return j.select("order_id", "items", "payment", F.col("allocated").cast("double").alias("allocated"),
                    (F.abs(F.col("allocated") - F.col("payment")) <= F.col("items") / F.lit(2.0)).alias("within_bound"))


B_ROWS = """
SELECT CAST(order_date AS VARCHAR) AS date, amount, product_no AS key, product_name AS name,
  CASE WHEN split_part(id, '_', 3) = '2' THEN 1 ELSE quantity END AS qty
FROM fx_orders WHERE channel = 'market'"""
C_ROWS = """
SELECT CAST(order_date AS VARCHAR) AS date, amount, order_id || '-' || split_part(id, '_', 3) AS key, product_name AS name,
  quantity AS qty,
  CASE WHEN status IN ('N10', 'N20') THEN 'PAYED' WHEN status = 'N40' THEN 'DELIVERED' WHEN status = 'E40' THEN 'EXCHANGED'
       WHEN status IN ('C40', 'CANCELED') THEN 'CANCELED' ELSE 'RETURNED' END AS tag
FROM fx_orders WHERE channel = 'store'"""
C_FEED = """SELECT date, amount, key, name, qty, tag FROM c_rows
UNION ALL SELECT date, amount, key, name, qty, 'PAYED' FROM c_rows WHERE tag = 'RETURNED'"""
FEED_VIEWS = A_VIEWS + [("b_rows", B_ROWS), ("c_rows", C_ROWS), ("c_feed", C_FEED)]

_B_SQL = """
SELECT 'B_' || oid AS id, 'B' AS channel, oid AS order_id, order_date, status, product_name, product_no,
  '' AS variant_code, CAST(CASE WHEN ln = 2 THEN 1 ELSE quantity END AS BIGINT) AS quantity, amount, customer
FROM (SELECT *, CAST(split_part(id, '_', 3) AS INT) AS ln,
        CASE WHEN CAST(split_part(id, '_', 3) AS INT) = 4 THEN 'box' ELSE '' END || order_id || '-' || split_part(id, '_', 3) AS oid
      FROM fx_orders WHERE channel = 'market') t"""


@plan("s02_channel_b_lines", oracle=with_views(["fx_orders"], f"SELECT {OUT} FROM ({_B_SQL}) b"))
def s02(spark, sf):
    return _out(nz.normalize_b(feeds.feed_b(spark, sf)))


_C_SQL = """
SELECT 'C_' || order_id || '-' || split_part(id, '_', 3) AS id, 'C' AS channel,
  order_id || '-' || split_part(id, '_', 3) AS order_id, order_date,
  CASE WHEN status IN ('N10', 'N20') THEN 'PAYED' WHEN status = 'N40' THEN 'DELIVERED' WHEN status = 'E40' THEN 'EXCHANGED'
       WHEN status IN ('C40', 'CANCELED') THEN 'CANCELED' ELSE 'RETURNED' END AS status,
  product_name, product_no, '' AS variant_code, quantity, amount, customer
FROM fx_orders WHERE channel = 'store'"""


def _c_lines(spark, sf):
    lines = nz.normalize_c(feeds.feed_c(spark, sf), feeds.C_STATUSES)
    return last_wins(lines, ["id"], ["ingest_seq"])


@plan("s03_channel_c_lines", oracle=with_views(["fx_orders"], f"SELECT {OUT} FROM ({_C_SQL}) c"))
def s03(spark, sf):
    return _out(_c_lines(spark, sf))


@plan("u03_all_channels", oracle=with_views(["fx_orders"], f"""
SELECT channel, status, COUNT(*) AS lines, CAST(SUM(quantity) AS BIGINT) AS qty,
  CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS amount
FROM (SELECT {OUT} FROM a_out UNION ALL {_B_SQL} UNION ALL {_C_SQL}) u GROUP BY channel, status""", A_VIEWS))
def u03(spark, sf):
    a = _a_lines(spark, sf)
    b = nz.normalize_b(feeds.feed_b(spark, sf))
    c = nz.normalize_c(feeds.feed_c(spark, sf), feeds.C_STATUSES)
    lines = last_wins(nz.union_channels(a, b, c), ["id"], ["ingest_seq"])
    return lines.groupBy("channel", "status").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("quantity").cast("bigint").alias("qty"),
        F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("amount"))


_CAT_SQL = """
SELECT p_partkey AS product_no, p_name AS product_name, 'V' || CAST(p_partkey AS VARCHAR) || '-' || CAST(i AS VARCHAR) AS variant_code,
  CASE WHEN i = 2 THEN '-' ELSE p_brand || '/' || CAST(i AS VARCHAR) END AS option_value,
  CAST(CASE WHEN p_partkey % 10 = 0 AND i = 1 THEN 0 ELSE (p_partkey * 37 + i * 11) % 60 END AS BIGINT) AS quantity,
  CAST(CASE WHEN p_partkey % 10 = 0 AND i = 1 THEN 0 ELSE 10 + p_partkey % 20 END AS BIGINT) AS safety_inventory,
  CASE WHEN p_partkey % 10 = 0 AND i = 1 THEN 'F' WHEN p_partkey % 2 = 0 THEN 'T' ELSE 'F' END AS use_inventory,
  p_partkey % 3 <> 0 AS selling, p_partkey % 5 <> 0 AS display
FROM part, range(1, 4) r(i) WHERE i <= 1 + p_size % 3"""


def _catalogue(spark, sf):
    return nz.catalogue_stock(feeds.landed_products(spark, sf))


@plan("s04_catalogue_stock", oracle=_CAT_SQL)
def s04(spark, sf):
    return _catalogue(spark, sf)


@plan("p12_safety_report", oracle=f"""
SELECT variant_code, quantity, safety_inventory,
  CASE WHEN quantity = 0 THEN 'out' WHEN quantity <= safety_inventory THEN 'low' ELSE 'ok' END AS st,
  CASE WHEN safety_inventory > 0 THEN least(CAST(quantity AS DOUBLE) / safety_inventory * 100.0, 100.0) ELSE 100.0 END AS availability
FROM ({_CAT_SQL}) c""")
def p12(spark, sf):
    return stock.safety_report(_catalogue(spark, sf)).select(
        "variant_code", "quantity", "safety_inventory", "st", "availability")


@plan("l04_low_stock_first", oracle=f"""
SELECT variant_code, st FROM (SELECT variant_code,
  CASE WHEN quantity = 0 THEN 'out' WHEN quantity <= safety_inventory THEN 'low' ELSE 'ok' END AS st
  FROM ({_CAT_SQL}) c) x WHERE st <> 'ok'
ORDER BY CASE st WHEN 'out' THEN 0 WHEN 'low' THEN 1 ELSE 2 END, variant_code LIMIT 50""")
def l04(spark, sf):
    r = stock.safety_report(_catalogue(spark, sf)).where(F.col("st") != "ok")
    return r.limit(50).select("variant_code", "st")
