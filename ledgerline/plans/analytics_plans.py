"""Registered analytics and order-page plans (G14-G18, G23-G25, J8, P7-P10,
F9, F10, L5, L7, K8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import analytics as an
from ledgerline.operators import claims
from ledgerline.plans.ingest_plans import FEED_VIEWS
from ledgerline.plans.params import AS_OF, SALES_END, SALES_START, js_rate_sql, js_round_sql, money_sum_sql
from ledgerline.plans.registry import plan
from ledgerline.sources import feeds
from ledgerline.sources import fixtures as fx
from ledgerline.sources.fixtures import with_views
from ledgerline.sources.tables import read_table

S, E = SALES_START, SALES_END
CH = ("A", "B", "C")


# ---- Spark inputs ----------------------------------------------------------------------

def _raw_a(spark, sf):
    return feeds.landed_a(spark, sf)


def _in_days(spark, sf, start, end):
    """The three feeds, only the landing folders of the days read."""
    return [feeds.in_days(x, start, end) for x in (_raw_a(spark, sf), feeds.feed_b(spark, sf), feeds.feed_c(spark, sf))]


def _order_rows(spark, sf, start=S, end=E):
    a, b, c = _in_days(spark, sf, start, end)
    return an.order_rows_a(a).unionByName(an.order_rows_b(b)).unionByName(an.order_rows_c(c))


def _product_rows(spark, sf, start=S, end=E):
    a, b, c = _in_days(spark, sf, start, end)
    return an.product_rows_a(a).unionByName(an.product_rows_b(b)).unionByName(an.product_rows_c(c))


# ---- SQL inputs --------------------------------------------------------------------------

ORDER_ROWS = f"""
SELECT 'A' AS channel, date, pay AS amount, status NOT LIKE 'C%' AND status NOT LIKE 'R%' AS valid FROM a_raw
UNION ALL SELECT 'B', date, amount, TRUE FROM b_rows
UNION ALL SELECT 'C', date, amount, tag NOT IN ('CANCELED', 'RETURNED') FROM c_feed"""
PRODUCT_ROWS = """
SELECT 'A' AS channel, l.product_no AS key, l.product_name AS name, CAST(l.q0 AS BIGINT) AS quantity,
  l.price * l.q0 AS revenue, r.date
FROM a_lines l JOIN a_raw r ON r.order_id = l.order_id WHERE r.status NOT LIKE 'C%' AND r.status NOT LIKE 'R%'
UNION ALL SELECT 'B', key, name, qty, amount, date FROM b_rows
UNION ALL SELECT 'C', key, name, qty, amount, date FROM c_feed WHERE tag NOT IN ('CANCELED', 'RETURNED')"""
IN_WIN = f"date BETWEEN '{S}' AND '{E}'"
SUMMARY = f"""
SELECT channel, COALESCE({money_sum_sql("CASE WHEN valid THEN amount END")}, 0) AS total_revenue,
  COUNT(CASE WHEN valid THEN 1 END) AS order_count
FROM order_rows WHERE {IN_WIN} GROUP BY channel"""
SUMMARY_OUT = f"""SELECT channel, total_revenue, order_count,
  CAST(CASE WHEN order_count > 0 THEN {js_round_sql('total_revenue / order_count')} ELSE 0 END AS BIGINT) AS avg_order_value
FROM summary0"""
TOP = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY revenue DESC, key) AS rank FROM (
  SELECT channel, key, min_by(name, (date, name)) AS name, CAST(SUM(quantity) AS BIGINT) AS quantity,
    {money_sum_sql('revenue')} AS revenue
  FROM product_rows WHERE {IN_WIN} GROUP BY channel, key) a) b WHERE rank <= 20"""
ALL_PRODUCTS = f"""
SELECT channel, key, min_by(name, (date, name)) AS name, CAST(SUM(quantity) AS BIGINT) AS quantity,
  {money_sum_sql('revenue')} AS revenue
FROM product_rows WHERE {IN_WIN} GROUP BY channel, key"""
AN_VIEWS = FEED_VIEWS + [("order_rows", ORDER_ROWS), ("product_rows", PRODUCT_ROWS), ("summary0", SUMMARY),
                         ("summary", SUMMARY_OUT), ("top", TOP), ("all_products", ALL_PRODUCTS)]
AN_BASE = ["fx_orders"]


def _summary(spark, sf):
    return an.channel_summary(an.in_window(_order_rows(spark, sf), S, E))


def _top(spark, sf):
    return an.channel_top_products(an.in_window(_product_rows(spark, sf), S, E), 20)


@plan("g14_channel_summary", oracle=with_views(AN_BASE, "SELECT * FROM summary", AN_VIEWS))
def g14(spark, sf):
    """Per-channel revenue, orders, average (each channel's rules)."""
    return _summary(spark, sf)


@plan("g14_channel_top_products", oracle=with_views(AN_BASE, "SELECT * FROM top", AN_VIEWS))
def g14_top(spark, sf):
    """Top 20 products per channel."""
    return _top(spark, sf)


@plan("g15_channel_daily", oracle=with_views(AN_BASE, f"""
SELECT channel, date, {money_sum_sql('amount')} AS amount FROM order_rows
WHERE {IN_WIN} AND valid AND date IS NOT NULL GROUP BY channel, date""", AN_VIEWS))
def g15(spark, sf):
    return an.channel_daily(an.in_window(_order_rows(spark, sf), S, E))


@plan("g17_channel_share", headline=True, oracle=with_views(AN_BASE, f"""
SELECT channel, total_revenue AS revenue, order_count AS orders, avg_order_value,
  CASE WHEN t > 0 THEN {js_rate_sql('total_revenue', 't')} ELSE 0.0 END AS share_percent
FROM summary, (SELECT CAST(SUM(CAST(total_revenue AS DECIMAL(18,2))) AS DOUBLE) AS t FROM summary) x""", AN_VIEWS))
def g17_share(spark, sf):
    return an.integrated_channels(_summary(spark, sf))


@plan("g17_integrated_summary", oracle=with_views(AN_BASE, f"""
SELECT total_revenue, total_orders,
  CAST(CASE WHEN total_orders > 0 THEN {js_round_sql('total_revenue / total_orders')} ELSE 0 END AS BIGINT) AS avg_order_value
FROM (SELECT COALESCE(CAST(SUM(CAST(total_revenue AS DECIMAL(18,2))) AS DOUBLE), 0) AS total_revenue,
  CAST(COALESCE(SUM(order_count), 0) AS BIGINT) AS total_orders FROM summary) t""", AN_VIEWS))
def g17_summary(spark, sf):
    return an.integrated_summary(_summary(spark, sf))


_DAILY_PIVOT = ",\n  ".join(
    f"COALESCE(CAST(SUM(CASE WHEN channel = '{c}' THEN CAST(amount AS DECIMAL(18,2)) END) AS DOUBLE), 0) AS {c}"
    for c in CH)


@plan("g17_daily_pivot", oracle=with_views(AN_BASE, f"""
SELECT date, {_DAILY_PIVOT}, COALESCE({money_sum_sql('amount')}, 0) AS total
FROM order_rows WHERE {IN_WIN} AND valid AND date IS NOT NULL GROUP BY date""", AN_VIEWS))
def g17_daily(spark, sf):
    return an.integrated_daily(an.channel_daily(an.in_window(_order_rows(spark, sf), S, E)), CH)


_PER_CH = ", ".join(
    f"CAST(SUM(CASE WHEN channel = '{c}' THEN CAST(revenue AS DECIMAL(18,2)) END) AS DOUBLE) AS revenue_{c}" for c in CH)


@plan("g17_top_products", oracle=with_views(AN_BASE, f"""
SELECT COALESCE(NULLIF(name, ''), 'unknown') AS product_name, CAST(SUM(quantity) AS BIGINT) AS total_qty,
  {money_sum_sql('revenue')} AS total_revenue, COUNT(*) AS n_channels, {_PER_CH}
FROM all_products GROUP BY COALESCE(NULLIF(name, ''), 'unknown') ORDER BY total_revenue DESC, product_name LIMIT 30""", AN_VIEWS))
def g17_top(spark, sf):
    rows = an.in_window(_product_rows(spark, sf), S, E)
    return an.integrated_products(an.channel_products(rows), CH, 30)


_J8_SQL = f"""
SELECT cur_revenue, prev_revenue,
  CASE WHEN prev_revenue > 0 THEN {js_rate_sql('cur_revenue - prev_revenue', 'prev_revenue')} END AS revenue_trend,
  cur_orders, prev_orders,
  CASE WHEN prev_orders > 0 THEN {js_rate_sql('cur_orders - prev_orders', 'prev_orders')} END AS orders_trend,
  cur_avg, prev_avg, CASE WHEN prev_avg > 0 THEN {js_rate_sql('cur_avg - prev_avg', 'prev_avg')} END AS avg_trend
FROM (SELECT *, CAST(CASE WHEN cur_orders > 0 THEN {js_round_sql('cur_revenue / cur_orders')} ELSE 0 END AS BIGINT) AS cur_avg,
        CAST(CASE WHEN prev_orders > 0 THEN {js_round_sql('prev_revenue / prev_orders')} ELSE 0 END AS BIGINT) AS prev_avg
      FROM (SELECT
        CAST(SUM(CASE WHEN cur AND valid THEN CAST(amount AS DECIMAL(18,2)) END) AS DOUBLE) AS cur_revenue,
        CAST(COUNT(CASE WHEN cur AND valid THEN 1 END) AS BIGINT) AS cur_orders,
        CAST(SUM(CASE WHEN prev AND valid THEN CAST(amount AS DECIMAL(18,2)) END) AS DOUBLE) AS prev_revenue,
        CAST(COUNT(CASE WHEN prev AND valid THEN 1 END) AS BIGINT) AS prev_orders
      FROM (SELECT *, CAST(date AS DATE) BETWEEN DATE '{AS_OF}' - INTERVAL 30 DAY AND DATE '{AS_OF}' AS cur,
                   CAST(date AS DATE) BETWEEN DATE '{AS_OF}' - INTERVAL 60 DAY AND DATE '{AS_OF}' - INTERVAL 30 DAY AS prev
            FROM order_rows) w) t) u"""


@plan("j08_period_comparison", oracle=with_views(AN_BASE, _J8_SQL, AN_VIEWS))
def j08(spark, sf):
    return an.period_comparison(_order_rows(spark, sf, an.comparison_start(AS_OF, 30), AS_OF), AS_OF, 30)


@plan("g24_run_totals", oracle=with_views(AN_BASE, f"""
SELECT CAST((SELECT COUNT(*) FROM a_raw WHERE {IN_WIN}) + (SELECT COUNT(*) FROM b_rows WHERE {IN_WIN})
  + (SELECT COUNT(*) FROM c_feed WHERE {IN_WIN}) AS BIGINT) AS total_count,
  CAST((SELECT COUNT(*) FROM a_out WHERE CAST(order_date AS VARCHAR) BETWEEN '{S}' AND '{E}')
  + (SELECT COUNT(*) FROM b_rows WHERE {IN_WIN}) + (SELECT COUNT(*) FROM c_rows WHERE {IN_WIN}) AS BIGINT) AS total_saved,
  CAST(0 AS BIGINT) AS failed_channels, CAST(3 AS BIGINT) AS channels""", AN_VIEWS))
def g24(spark, sf):
    """G24 over per-channel run metrics: records fetched and lines saved
    (after the upsert) for the sales window."""
    from ledgerline.functions.rules import last_wins
    from ledgerline.operators import normalize as nz
    raw_a, raw_b, raw_c = _raw_a(spark, sf), feeds.feed_b(spark, sf), feeds.feed_c(spark, sf)
    lines = nz.union_channels(nz.normalize_a(raw_a), nz.normalize_b(raw_b), nz.normalize_c(raw_c, feeds.C_STATUSES))
    # of a line only its date is needed; it is decided by these columns, as in the upsert
    saved = last_wins(lines.select("id", "channel", "order_id", "order_date", "ingest_seq"), ["id"], ["ingest_seq"]) \
        .where(F.col("order_date").between(F.lit(S).cast("date"), F.lit(E).cast("date"))) \
        .groupBy("channel").agg(F.count(F.lit(1)).alias("saved"))
    fetched = an.in_window(_order_rows(spark, sf), S, E).groupBy("channel").agg(F.count(F.lit(1)).alias("count"))
    metrics = fetched.join(saved, "channel", "full").select(
        "channel", F.lit("success").alias("status"), F.coalesce("count", F.lit(0)).alias("count"),
        F.coalesce("saved", F.lit(0)).alias("saved"))
    return an.run_totals(metrics)


# ---- G23 / G25 ------------------------------------------------------------------------------

@plan("g23_payload_profile", oracle="""
SELECT COUNT(*) AS total_rows, CAST(SUM(length(props)) AS BIGINT) AS raw_total_chars,
  COUNT(CASE WHEN props <> '' AND props <> '{}' THEN 1 END) AS non_empty_rows,
  CAST(CASE WHEN COUNT(*) > 0 THEN floor(SUM(length(props)) / COUNT(*) + 0.5) ELSE 0 END AS BIGINT) AS avg_raw_chars
FROM events""")
def g23(spark, sf):
    """Size profile of the raw JSON payload column (characters)."""
    ev = read_table(spark, sf, "events")
    agg = ev.agg(F.count(F.lit(1)).alias("total_rows"), F.sum(F.length("props")).cast("bigint").alias("raw_total_chars"),
                 F.count(F.when((F.col("props") != "") & (F.col("props") != "{}"), 1)).alias("non_empty_rows"))
    from ledgerline.functions.rules import js_round
    return agg.withColumn("avg_raw_chars", F.when(F.col("total_rows") > 0,
                                                  js_round(F.col("raw_total_chars") / F.col("total_rows")))
                          .otherwise(F.lit(0)).cast("bigint"))


@plan("g25_hour_histogram", oracle="""
SELECT hour(ts) AS hour, COUNT(*) AS events FROM events GROUP BY hour(ts)""")
def g25_hours(spark, sf):
    return an.hour_histogram(read_table(spark, sf, "events"))


def _label_sql(col: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in claims.STATUS_LABELS.items())
    return f"CASE {col} {whens} ELSE COALESCE(NULLIF({col}, ''), '?') END"


@plan("g25_status_funnel", oracle=with_views(["fx_orders"], f"""
SELECT {_label_sql('status')} AS stage, COUNT(DISTINCT order_id) AS orders FROM fx_orders GROUP BY 1"""))
def g25_funnel(spark, sf):
    o = fx.orders_table(spark, sf)
    return o.groupBy(claims.status_label("status").alias("stage")).agg(F.countDistinct("order_id").alias("orders"))


@plan("g25_recent_channel_share", oracle=with_views(["fx_orders"], f"""
SELECT days, channel, revenue, CASE WHEN t > 0 THEN {js_rate_sql('revenue', 't')} ELSE 0.0 END AS share_percent
FROM (SELECT days, channel, revenue, SUM(CAST(revenue AS DECIMAL(18,2))) OVER (PARTITION BY days) AS t FROM (
  SELECT d.days, o.channel,
    COALESCE(CAST(SUM(CASE WHEN o.order_date > DATE '{AS_OF}' - d.days * INTERVAL 1 DAY
                           THEN CAST(o.amount AS DECIMAL(18,2)) END) AS DOUBLE), 0) AS revenue
  FROM fx_orders o, (VALUES (7), (14), (30)) d(days)
  WHERE status NOT ILIKE 'C%' AND status NOT ILIKE 'R%' AND o.order_date > DATE '{AS_OF}' - INTERVAL 30 DAY
    AND o.order_date <= DATE '{AS_OF}'
  GROUP BY d.days, o.channel) a) b"""))
def g25_share(spark, sf):
    return an.recent_channel_share(fx.orders_table(spark, sf), AS_OF)


# ---- order pages (P7-P10, F9, F10, G18, L5, K8) ---------------------------------------------------

_NAME = ("CASE WHEN n > 1 THEN first_name || ' 외 ' || CAST(n - 1 AS VARCHAR) || '건' "
         "ELSE COALESCE(first_name, '') END")


ORDER_ROWS_SQL = f"""
SELECT order_id, date || ' 10:15' AS order_time, customer AS buyer, {_NAME} AS item_name,
  CAST(qsum AS BIGINT) AS total_qty, status, {_label_sql('status')} AS status_label,
  CAST(floor(page_amount + 0.5) AS BIGINT) AS amount, regexp_matches(status, '^[CRE]') AS is_refund,
  '-' AS payment_method
FROM a_raw"""


@plan("p07_order_rows", oracle=with_views(AN_BASE, ORDER_ROWS_SQL, AN_VIEWS))
def p07(spark, sf):
    return claims.order_rows(_raw_a(spark, sf))


@plan("p09_claim_rows", oracle=with_views(AN_BASE, f"""
SELECT order_id, date || ' 10:15' AS order_time, COALESCE(NULLIF(names_comma, ''), '-') AS items,
  status, {_label_sql('status')} AS status_label, CAST(floor(page_amount + 0.5) AS BIGINT) AS amount, '-' AS reason
FROM a_raw WHERE substr(status, 1, 1) IN ('C', 'R', 'E')""", AN_VIEWS))
def p09(spark, sf):
    return claims.claim_rows(_raw_a(spark, sf))


@plan("p08_order_detail", oracle=with_views(AN_BASE, f"""
SELECT l.order_id, CAST(row_number() OVER (ORDER BY l.l) - 1 AS INT) AS pos, l.product_name,
  'opt' AS option_value, CASE WHEN l.l = 5 THEN '1' ELSE CAST(l.q AS VARCHAR) END AS quantity,
  CAST(floor(l.price + 0.5) AS BIGINT) AS price, l.status, {_label_sql('l.status')} AS status_label
FROM a_lines l WHERE l.order_id = '3'""", AN_VIEWS))
def p08(spark, sf):
    return claims.order_detail(_raw_a(spark, sf), "3")


@plan("f09_status_filter", oracle=with_views(AN_BASE, """
SELECT order_id, status FROM a_raw WHERE status LIKE 'R%'
UNION ALL SELECT order_id, status FROM a_raw WHERE status = 'E40'""", AN_VIEWS))
def f09(spark, sf):
    raw = _raw_a(spark, sf)
    a = claims.status_filter(raw, "R").select("order_id", F.col("order_status").alias("status"))
    b = claims.status_filter(raw, "E40").select("order_id", F.col("order_status").alias("status"))
    return a.unionByName(b)


@plan("f10_claims_view", oracle=with_views(AN_BASE, """
SELECT status, COUNT(*) AS orders FROM a_raw WHERE substr(status, 1, 1) IN ('C', 'R', 'E') GROUP BY status""",
      AN_VIEWS))
def f10(spark, sf):
    return claims.claims_view(_raw_a(spark, sf)).groupBy(F.col("order_status").alias("status")) \
        .agg(F.count(F.lit(1)).alias("orders"))


def _kpi_sql(where: str = "TRUE") -> str:
    c = "substr(status, 1, 1)"
    dec = "CAST(page_amount AS DECIMAL(18,2))"
    return f"""
SELECT total_orders, CAST(floor(CAST(rev AS DOUBLE) + 0.5) AS BIGINT) AS revenue,
  CAST(CASE WHEN total_orders > 0 THEN floor(CAST(rev AS DOUBLE) / greatest(total_orders - cancel_count - return_count, 1) + 0.5)
       ELSE 0 END AS BIGINT) AS avg_order,
  cancel_count, return_count, exchange_count, cancel_count + return_count + exchange_count AS claim_count,
  CAST(floor(CAST(ca AS DOUBLE) + 0.5) AS BIGINT) AS cancel_amount, CAST(floor(CAST(ra AS DOUBLE) + 0.5) AS BIGINT) AS return_amount,
  CAST(floor(CAST(ca + ra AS DOUBLE) + 0.5) AS BIGINT) AS refund_total
FROM (SELECT COUNT(*) AS total_orders,
  COALESCE(SUM(CASE WHEN {c} NOT IN ('C', 'R', 'E') THEN {dec} END), 0) AS rev,
  COALESCE(SUM(CASE WHEN {c} = 'C' THEN {dec} END), 0) AS ca, COALESCE(SUM(CASE WHEN {c} = 'R' THEN {dec} END), 0) AS ra,
  COUNT(CASE WHEN {c} = 'C' THEN 1 END) AS cancel_count, COUNT(CASE WHEN {c} = 'R' THEN 1 END) AS return_count,
  COUNT(CASE WHEN {c} = 'E' THEN 1 END) AS exchange_count FROM a_raw WHERE {where}) k"""


@plan("g18_order_kpis", oracle=with_views(AN_BASE, _kpi_sql(), AN_VIEWS))
def g18(spark, sf):
    return claims.order_kpis(_raw_a(spark, sf))


@plan("g18_claim_kpis", oracle=with_views(AN_BASE, _kpi_sql("substr(status, 1, 1) IN ('C', 'R', 'E')"), AN_VIEWS))
def g18_claims(spark, sf):
    return claims.order_kpis(claims.claims_view(_raw_a(spark, sf)))


@plan("l05_orders_page", oracle=with_views(AN_BASE, f"""
SELECT * FROM ({ORDER_ROWS_SQL}) r ORDER BY order_time DESC, order_id LIMIT 50 OFFSET 100""", AN_VIEWS))
def l05_orders(spark, sf):
    return claims.order_rows(_raw_a(spark, sf)).orderBy(F.col("order_time").desc(), "order_id").offset(100).limit(50)


@plan("k08_order_export_rows", oracle=with_views(AN_BASE, f"""
SELECT order_id, date || ' 10:15' AS order_time, customer AS buyer, COALESCE(names_slash, '') AS items,
  CAST(qsum AS VARCHAR) AS quantity, CASE status {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in claims.STATUS_LABELS.items())}
  ELSE status END AS status,
  CASE WHEN okey % 11 = 0 THEN '0' ELSE CAST(CAST(pay AS BIGINT) AS VARCHAR) END AS amount
FROM a_raw""", AN_VIEWS))
def k08(spark, sf):
    return claims.export_rows(_raw_a(spark, sf))
