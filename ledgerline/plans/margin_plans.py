"""Registered margin plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import margin, stock
from ledgerline.plans.params import SALES_END, SALES_START, SALES_WHERE, js_rate_sql, js_round_sql
from ledgerline.plans.registry import plan
from ledgerline.sources import fixtures as fx
from ledgerline.sources.fixtures import with_views

S, E = SALES_START, SALES_END
FIELDS = ("cost", "sell", "name", "option", "category")


def _map_sql(key: str) -> str:
    return (f"SELECT k, cost, sell, name, option, category FROM (SELECT {key} AS k, cost_price AS cost, "
            f"sell_price AS sell, item_name AS name, option_name AS option, category, "
            f"row_number() OVER (PARTITION BY {key} ORDER BY seq DESC) AS rn FROM fx_costs "
            f"WHERE cost_price > 0 AND {key} <> '') t WHERE rn = 1")


def _first_hit(aliases, field):
    whens = " ".join(f"WHEN {a}.k IS NOT NULL THEN {a}.{field}" for a in aliases)
    return f"CASE {whens} END"


_BR0 = ("SELECT i.supplier_option AS so, CAST(substr(i.product_code, 2) AS BIGINT) AS iseq, "
        + ", ".join(f"{_first_hit(['c1', 'b1', 'b2', 'b3'], f)} AS {f}" for f in FIELDS)
        + ", i.product_name AS inv_name, COALESCE(c1.k, b1.k, b2.k, b3.k) IS NOT NULL AS hit "
        "FROM fx_inventory i LEFT JOIN byc c1 ON c1.k = i.supplier_option LEFT JOIN byb b1 ON b1.k = i.supplier_option "
        "LEFT JOIN byb b2 ON b2.k = i.barcode LEFT JOIN byb b3 ON b3.k = i.product_code "
        "WHERE i.supplier_option <> ''")
_BR = ("SELECT so AS k, cost, sell, name, option, category, inv_name FROM (SELECT *, row_number() OVER "
       "(PARTITION BY so ORDER BY iseq DESC) AS rn FROM br0 WHERE hit) t WHERE rn = 1")
_TOP = (f"SELECT product_name, product_no, variant_code, CAST(SUM(quantity) AS BIGINT) AS total_qty, "
        f"SUM(CAST(amount AS DECIMAL(18,2))) AS revenue_dec, COUNT(*) AS order_count FROM fx_orders "
        f"WHERE {SALES_WHERE} AND product_name <> '' GROUP BY product_name, product_no, variant_code "
        f"ORDER BY revenue_dec DESC, product_name, product_no, variant_code LIMIT 100")
_RULE = ("CASE WHEN t.variant_code <> '' AND m1.k IS NOT NULL THEN 1 WHEN t.variant_code <> '' AND m2.k IS NOT NULL "
         "THEN 2 WHEN t.variant_code <> '' AND m3.k IS NOT NULL THEN 3 WHEN t.product_no <> '' AND m4.k IS NOT NULL "
         "THEN 4 WHEN t.product_no <> '' AND m5.k IS NOT NULL THEN 5 ELSE 0 END")



_M = (f"SELECT t.*, {_RULE} AS rule, " + ", ".join(f"m1.{f} AS m1_{f}, m2.{f} AS m2_{f}, m3.{f} AS m3_{f}, "
                                                   f"m4.{f} AS m4_{f}, m5.{f} AS m5_{f}" for f in FIELDS)
      + ", m3.inv_name AS m3_inv_name FROM top t LEFT JOIN byc m1 ON m1.k = t.variant_code "
      "LEFT JOIN byb m2 ON m2.k = t.variant_code LEFT JOIN br m3 ON m3.k = t.variant_code "
      "LEFT JOIN byc m4 ON m4.k = t.product_no LEFT JOIN byb m5 ON m5.k = t.product_no")


def _mpick(field):
    return "CASE rule " + " ".join(f"WHEN {i} THEN m{i}_{field}" for i in range(1, 6)) + " END"


_REPORT = f"""
SELECT product_name, product_no, variant_code,
  COALESCE(CASE WHEN rule = 3 THEN COALESCE(NULLIF(m3_inv_name, ''), NULLIF(m3_name, ''), '') END, {_mpick('name')}, '') AS matched_inv_name,
  CASE WHEN rule > 0 THEN COALESCE({_mpick('category')}, '') ELSE '' END AS category,
  total_qty, CAST(revenue_dec AS DOUBLE) AS total_revenue, order_count,
  cost AS cost_price, CASE WHEN rule > 0 THEN {_mpick('sell')} ELSE 0.0 END AS sell_price,
  CAST(CAST(cost AS DECIMAL(18,2)) * total_qty AS DOUBLE) AS total_cost,
  CAST(revenue_dec - CAST(cost AS DECIMAL(18,2)) * total_qty AS DOUBLE) AS margin,
  CASE WHEN revenue_dec > 0 THEN {js_rate_sql('revenue_dec - CAST(cost AS DECIMAL(18,2)) * total_qty', 'revenue_dec')}
       ELSE 0.0 END AS margin_rate,
  CAST(CASE WHEN total_qty > 0 THEN {js_round_sql('CAST(revenue_dec AS DOUBLE) / total_qty - cost')} ELSE 0 END AS BIGINT) AS unit_margin,
  CASE WHEN rule > 0 THEN 'code' ELSE 'none' END AS match_type, rule AS match_rule
FROM (SELECT *, CASE WHEN rule > 0 THEN {_mpick('cost')} ELSE 0.0 END AS cost FROM m) x"""

MARGIN_VIEWS = [("byc", _map_sql("item_code")), ("byb", _map_sql("barcode")), ("br0", _BR0), ("br", _BR),
                ("top", _TOP), ("m", _M), ("report", _REPORT)]
MARGIN_BASE = ["fx_orders", "fx_inventory", "fx_costs"]


def _report(spark, sf):
    return margin.margin_report(fx.orders_table(spark, sf), fx.inventory(spark, sf, keep_seq=True),
                                fx.costs(spark, sf), S, E, 100)


@plan("g12_margin_report", headline=True, oracle=with_views(MARGIN_BASE, "SELECT * FROM report", MARGIN_VIEWS))
def g12(spark, sf):
    return _report(spark, sf)


@plan("j04_match_rules", oracle=with_views(MARGIN_BASE, """
SELECT match_rule, COUNT(*) AS groups FROM report GROUP BY match_rule""", MARGIN_VIEWS))
def j04(spark, sf):
    return _report(spark, sf).groupBy("match_rule").agg(F.count(F.lit(1)).alias("groups"))


_SUMMARY = f"""
SELECT CAST(rev AS DOUBLE) AS total_revenue, CAST(cost AS DOUBLE) AS total_cost, CAST(rev - cost AS DOUBLE) AS total_margin,
  CASE WHEN rev > 0 THEN {js_rate_sql('rev - cost', 'rev')} ELSE 0.0 END AS margin_rate,
  CAST(mrev AS DOUBLE) AS matched_revenue, CAST(mcost AS DOUBLE) AS matched_cost, CAST(mrev - mcost AS DOUBLE) AS matched_margin,
  CASE WHEN mrev > 0 THEN {js_rate_sql('mrev - mcost', 'mrev')} ELSE 0.0 END AS matched_margin_rate,
  matched_products, unmatched_products
FROM (SELECT COALESCE(SUM(CAST(total_revenue AS DECIMAL(18,2))), 0) AS rev, COALESCE(SUM(CAST(total_cost AS DECIMAL(18,2))), 0) AS cost,
  COALESCE(SUM(CASE WHEN match_type <> 'none' THEN CAST(total_revenue AS DECIMAL(18,2)) END), 0) AS mrev,
  COALESCE(SUM(CASE WHEN match_type <> 'none' THEN CAST(total_cost AS DECIMAL(18,2)) END), 0) AS mcost,
  COUNT(CASE WHEN match_type <> 'none' THEN 1 END) AS matched_products,
  COUNT(CASE WHEN match_type = 'none' THEN 1 END) AS unmatched_products FROM report) a"""


@plan("g13_margin_summary", oracle=with_views(MARGIN_BASE, _SUMMARY, MARGIN_VIEWS))
def g13(spark, sf):
    return margin.margin_summary(_report(spark, sf))


@plan("j05_cost_maps", oracle=with_views(["fx_costs"], f"""
SELECT 'code' AS map, k AS key, cost, sell, name, option, category FROM ({_map_sql('item_code')}) a
UNION ALL SELECT 'barcode', k, cost, sell, name, option, category FROM ({_map_sql('barcode')}) b"""))
def j05(spark, sf):
    by_code, by_barcode = margin.cost_maps(fx.costs(spark, sf))
    return (by_code.select(F.lit("code").alias("map"), "key", "entry.*")
            .unionByName(by_barcode.select(F.lit("barcode").alias("map"), "key", "entry.*")))


@plan("j03_cost_bridge", oracle=with_views(["fx_inventory", "fx_costs"],
      "SELECT k AS supplier_option, cost, sell, name, option, category, inv_name FROM br", MARGIN_VIEWS[:4]))
def j03(spark, sf):
    by_code, by_barcode = margin.cost_maps(fx.costs(spark, sf))
    return margin.cost_bridge(fx.inventory(spark, sf, keep_seq=True), by_code, by_barcode) \
        .select("supplier_option", "entry.*")


@plan("g22_cost_coverage", oracle=with_views(["fx_costs"], """
SELECT COUNT(*) AS count, COUNT(CASE WHEN cost_price > 0 THEN 1 END) AS with_cost FROM fx_costs"""))
def g22(spark, sf):
    return margin.cost_coverage(fx.costs(spark, sf))


_COST_OUT = "item_code, barcode, item_name, option_name, cost_price, sell_price, category, supplier"


@plan("s08_cost_json", oracle=with_views(["fx_costs"], f"SELECT seq, {_COST_OUT} FROM fx_costs"))
def s08(spark, sf):
    """Cost list posted as JSON items (text), parsed with an explicit schema."""
    c = fx.costs(spark, sf)
    posted = c.select("seq", F.to_json(F.struct(
        F.col("item_code").alias("code"), F.col("barcode").alias("barcode"), F.col("item_name").alias("name"),
        F.col("option_name").alias("option"), F.col("cost_price").alias("cost"), F.col("sell_price").alias("sell"),
        F.col("category").alias("category"), F.col("supplier").alias("supplier"))).alias("json"))
    items = posted.select("seq", F.from_json("json", margin.COST_JSON_SCHEMA).alias("it")).select("seq", "it.*")
    return margin.cost_items(items)


@plan("k04_cost_append", oracle=with_views(["fx_costs"], f"""
SELECT {_COST_OUT} FROM fx_costs UNION ALL SELECT {_COST_OUT} FROM fx_costs WHERE seq % 2 = 0"""))
def k04(spark, sf):
    """Append (no de-duplication): the list plus a re-posted half of it."""
    c = fx.costs(spark, sf)
    return c.select(*margin.COST_COLUMNS).unionByName(c.where(F.col("seq") % 2 == 0).select(*margin.COST_COLUMNS))


_CELLS = [f"c{i}" for i in range(10)]


def _cost_sheet_raw(spark, sf):
    """The uploaded cost sheet (staged rows), header located."""
    from ledgerline.sources.staging import staged
    from ledgerline.sources.tables import table_path
    rows = staged(spark, "sheet_costs", [table_path(sf, "part")], lambda: _cost_sheet_rows(spark, sf))
    return stock.locate_header(rows, _CELLS, "pos")


def _cost_sheet_rows(spark, sf):
    """Cost list as a positional sheet: a title row, a header row (marker in
    column 0), then data rows; costs written with thousands separators."""
    c = fx.costs(spark, sf)
    data = c.select(
        (F.col("seq") + F.lit(10)).alias("pos"), F.col("item_code").alias("c0"), F.col("barcode").alias("c1"),
        F.col("item_name").alias("c2"), F.col("option_name").alias("c3"),
        F.format_number(F.col("cost_price"), 2).alias("c4"), F.col("sell_price").cast("string").alias("c5"),
        F.col("category").alias("c6"), F.lit("x").alias("c7"), F.lit(None).cast("string").alias("c8"),
        F.col("supplier").alias("c9"))
    one = c.groupBy().agg(F.count(F.lit(1)).alias("_n"))
    title = one.select(F.lit(0).cast("bigint").alias("pos"),
                       *[F.lit("cost list" if i == 2 else None).cast("string").alias(x) for i, x in enumerate(_CELLS)])
    header = one.select(F.lit(1).cast("bigint").alias("pos"),
                        *[F.lit(stock.HEADER_MARKER if i == 0 else f"col{i}").alias(x) for i, x in enumerate(_CELLS)])
    return title.unionByName(header).unionByName(data)


@plan("s07_cost_sheet", oracle=with_views(["fx_costs"], f"""
SELECT seq + 10 AS pos, {_COST_OUT} FROM fx_costs WHERE item_code <> ''"""))
def s07(spark, sf):
    return margin.parse_cost_sheet(_cost_sheet_raw(spark, sf), _CELLS)
