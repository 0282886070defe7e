"""Registered stock plans (J1, J2, J7, K6, K9, K10, G8-G11, G19-G21, L1, L3, L5,
P11, F4-F8, S6, S9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions.rules import month_prune
from ledgerline.operators import stock
from ledgerline.plans.params import (EFF_SQL, SNAPSHOT_DAY, STOCK_END, STOCK_START)
from ledgerline.plans.registry import plan
from ledgerline.sources import fixtures as fx
from ledgerline.sources.fixtures import with_views
from ledgerline.sources.staging import staged
from ledgerline.sources.tables import table_path

DAY = SNAPSHOT_DAY
SHEET_STOCK_HEADERS = stock.STOCK_SHEET_HEADERS
OPEN_HEADERS = stock.OPENING_SHEET_HEADERS


# ---- SQL pieces ------------------------------------------------------------------

def _maps_sql(windows: dict[str, str]) -> list[tuple[str, str]]:
    """CTEs ``bv`` (variant_code, <w>_v...) and ``bn`` (nk, <w>_n...)."""
    any_w = " OR ".join(f"({w})" for w in windows.values())
    sv = ", ".join(f"CAST(SUM(CASE WHEN {w} THEN quantity END) AS BIGINT) AS {k}_v" for k, w in windows.items())
    sn = ", ".join(f"CAST(SUM(CASE WHEN {w} THEN quantity END) AS BIGINT) AS {k}_n" for k, w in windows.items())
    return [
        ("bv", f"SELECT variant_code, {sv} FROM fx_orders WHERE {EFF_SQL} AND ({any_w}) AND variant_code <> '' "
               f"GROUP BY variant_code"),
        ("bn", f"SELECT product_name AS nk, {sn} FROM fx_orders WHERE {EFF_SQL} AND ({any_w}) GROUP BY product_name"),
    ]


def _pick_sql(w: str, alias: str = "i") -> str:
    return (f"CAST(COALESCE(CASE WHEN {alias}.supplier_option <> '' AND bv.{w}_v <> 0 THEN bv.{w}_v END, "
            f"CASE WHEN bn.{w}_n <> 0 THEN bn.{w}_n END, 0) AS BIGINT)")


def _source_sql(w: str, alias: str = "i") -> str:
    return (f"CASE WHEN {alias}.supplier_option <> '' AND bv.{w}_v <> 0 THEN 'variant' "
            f"WHEN bn.{w}_n <> 0 THEN 'name' ELSE 'zero' END")


_JOIN = "LEFT JOIN bv ON i.supplier_option = bv.variant_code LEFT JOIN bn ON i.product_name = bn.nk"

SNAPSHOT_SQL = f"""
SELECT '{DAY}' AS date, i.product_code, i.product_name, i.option_name, i.stock_qty AS base_stock,
  {_pick_sql('day')} AS shipped, i.stock_qty - {_pick_sql('day')} AS expected_stock,
  i.supplier, i.category, {_source_sql('day')} AS shipped_source
FROM fx_inventory i {_JOIN}"""
SNAPSHOT_VIEWS = _maps_sql({"day": f"order_date = DATE '{DAY}'"}) + [("snap", SNAPSHOT_SQL)]

# Base date of the first row in stock order; all fixture rows share it.
_BASE = "(SELECT max_by(base_date, (stock_qty, product_code)) FROM fx_inventory)"
STATUS_WINDOWS = {
    "prev": f"order_date >= {_BASE} AND order_date < DATE '{STOCK_START}'",
    "per": f"order_date >= DATE '{STOCK_START}' AND order_date <= DATE '{STOCK_END}'",
}
STATUS_SQL = f"""
SELECT i.product_code, i.product_name, i.option_name, i.supplier, i.category,
  i.stock_qty - {_pick_sql('prev')} AS base_stock, {_pick_sql('per')} AS shipped,
  i.stock_qty - {_pick_sql('prev')} - {_pick_sql('per')} AS expected_stock, {_source_sql('per')} AS shipped_source,
  i.cost_price, i.sell_price, i.barcode, i.stock_qty
FROM fx_inventory i {_JOIN}"""
STATUS_VIEWS = _maps_sql(STATUS_WINDOWS) + [("st", STATUS_SQL)]

# Stock page: sheet items = stock rows; opening = uploaded stock, outgoing =
# shipped in the period; closing = opening - outgoing.
PAGE_SQL = """
SELECT row_number() OVER (ORDER BY CAST(substr(product_code, 2) AS BIGINT)) AS no, product_code AS code, barcode, product_name AS name,
  option_name AS option, category, cost_price AS cost, sell_price AS price,
  stock_qty AS opening, shipped AS outgoing, stock_qty - shipped AS closing
FROM st"""
PAGE_VIEWS = STATUS_VIEWS + [("page", PAGE_SQL)]


# ---- Spark builders ------------------------------------------------------------

def _snapshot(spark, sf):
    return stock.daily_snapshot(fx.orders_table(spark, sf), fx.inventory(spark, sf), DAY, with_source=True)


def _status_all(spark, sf):
    return stock.stock_status(fx.orders_table(spark, sf), fx.inventory(spark, sf), STOCK_START, STOCK_END)


def _page(spark, sf):
    """Stock page over the stock table: opening = stock, outgoing = period
    shipped (J2), numbered by sheet order (before the order data joins in)."""
    from ledgerline.functions.rules import numbered
    inv = numbered(fx.inventory(spark, sf, keep_seq=True), "seq", "no")
    j = stock.stock_status_rows(fx.orders_table(spark, sf), inv, STOCK_START, STOCK_END,
                                extra=("no", "barcode", "cost_price", "sell_price", "stock_qty"))
    return j.select("no", F.col("product_code").alias("code"), "barcode", F.col("product_name").alias("name"),
                    F.col("option_name").alias("option"), "category", F.col("cost_price").alias("cost"),
                    F.col("sell_price").alias("price"), F.col("stock_qty").alias("opening"),
                    F.col("shipped").alias("outgoing"), (F.col("stock_qty") - F.col("shipped")).alias("closing"))


@plan("j01_daily_snapshot", headline=True, oracle=with_views(["fx_orders", "fx_inventory"],
      "SELECT * FROM snap", SNAPSHOT_VIEWS))
def j01(spark, sf):
    return _snapshot(spark, sf)


@plan("j01_shipped_totals", oracle=with_views(["fx_orders"], """
SELECT COALESCE((SELECT SUM(day_v) FROM bv), 0)::BIGINT AS shipped_by_variant,
  COALESCE((SELECT SUM(day_n) FROM bn), 0)::BIGINT AS shipped_by_name,
  (COALESCE((SELECT SUM(day_v) FROM bv), 0) + COALESCE((SELECT SUM(day_n) FROM bn), 0))::BIGINT AS total_shipped""",
      _maps_sql({"day": f"order_date = DATE '{DAY}'"})))
def j01_totals(spark, sf):
    return stock.snapshot_shipped_totals(fx.orders_table(spark, sf), DAY)


@plan("g10_snapshot_summary", oracle=with_views(["fx_orders", "fx_inventory"], """
SELECT COUNT(*) AS total_products, CAST(SUM(base_stock) AS BIGINT) AS total_base_stock,
  CAST(SUM(shipped) AS BIGINT) AS total_shipped, CAST(SUM(expected_stock) AS BIGINT) AS total_expected,
  COUNT(CASE WHEN shipped > 0 THEN 1 END) AS moved_products FROM snap""", SNAPSHOT_VIEWS))
def g10(spark, sf):
    return stock.snapshot_summary(_snapshot(spark, sf))


@plan("l03_snapshot_list", oracle=with_views(["fx_orders", "fx_inventory"], """
SELECT * FROM snap WHERE shipped > 0 ORDER BY shipped DESC, base_stock DESC, product_code, option_name LIMIT 100""",
      SNAPSHOT_VIEWS))
def l03(spark, sf):
    return stock.snapshot_list(_snapshot(spark, sf), shipped_only=True, limit=100)


@plan("f06_snapshot_supplier_search", oracle=with_views(["fx_orders", "fx_inventory"], """
SELECT * FROM snap WHERE (strpos(lower(product_name), 'ring') > 0 OR strpos(lower(product_code), 'ring') > 0)
  AND supplier = 'SUP3' AND category = 'ECONOMY'""", SNAPSHOT_VIEWS))
def f06(spark, sf):
    return stock.snapshot_list(_snapshot(spark, sf), search="RING", supplier="SUP3", category="ECONOMY")


@plan("g20_snapshot_filters", oracle=with_views(["fx_orders", "fx_inventory"], """
SELECT DISTINCT 'supplier' AS kind, supplier AS value FROM snap WHERE supplier <> ''
UNION SELECT DISTINCT 'category', category FROM snap WHERE category <> ''""", SNAPSHOT_VIEWS))
def g20(spark, sf):
    return stock.filter_lists(_snapshot(spark, sf))


@plan("g20_stock_filters", oracle=with_views(["fx_inventory"], """
SELECT DISTINCT 'supplier' AS kind, supplier AS value FROM fx_inventory WHERE supplier <> ''
UNION SELECT DISTINCT 'category', category FROM fx_inventory WHERE category <> ''"""))
def g20_stock(spark, sf):
    return stock.filter_lists(fx.inventory(spark, sf))


@plan("g21_snapshot_dates", oracle=with_views(["fx_orders"], """
SELECT CAST(order_date AS VARCHAR) AS date FROM (SELECT DISTINCT order_date FROM fx_orders) d
ORDER BY order_date DESC LIMIT 30"""))
def g21(spark, sf):
    """Dates with a snapshot: the daily job snapshots every collection day."""
    o = fx.orders_table(spark, sf)
    return (o.select("order_date").distinct().orderBy(F.col("order_date").desc()).limit(30)
             .select(F.col("order_date").cast("string").alias("date")))


@plan("j02_stock_status", headline=True, oracle=with_views(["fx_orders", "fx_inventory"], """
SELECT product_code, product_name, option_name, supplier, category, base_stock, shipped, expected_stock, shipped_source
FROM st ORDER BY shipped DESC, base_stock DESC, product_code, option_name LIMIT 200""", STATUS_VIEWS))
def j02(spark, sf):
    return stock.stock_status(fx.orders_table(spark, sf), fx.inventory(spark, sf), STOCK_START, STOCK_END,
                              limit=200)


@plan("j02_stock_status_all", oracle=with_views(["fx_orders", "fx_inventory"], """
SELECT product_code, product_name, option_name, supplier, category, base_stock, shipped, expected_stock, shipped_source
FROM st""", STATUS_VIEWS))
def j02_all(spark, sf):
    return _status_all(spark, sf)


@plan("j02_stock_status_summary", oracle=with_views(["fx_orders", "fx_inventory"], f"""
SELECT '{STOCK_START}' AS start_date, '{STOCK_END}' AS end_date, CAST({_BASE} AS VARCHAR) AS base_date,
  COUNT(*) AS total_products, CAST(SUM(base_stock) AS BIGINT) AS total_base_stock,
  CAST(SUM(shipped) AS BIGINT) AS total_shipped, CAST(SUM(expected_stock) AS BIGINT) AS total_expected,
  COUNT(CASE WHEN shipped > 0 THEN 1 END) AS moved_products FROM st""", STATUS_VIEWS))
def j02_summary(spark, sf):
    return stock.stock_status_summary(fx.orders_table(spark, sf), fx.inventory(spark, sf), STOCK_START, STOCK_END)


@plan("f05_stock_status_shipped_only", oracle=with_views(["fx_orders", "fx_inventory"], """
SELECT product_code, product_name, option_name, supplier, category, base_stock, shipped, expected_stock, shipped_source
FROM st WHERE shipped > 0 AND supplier = 'SUP3'""", STATUS_VIEWS))
def f05(spark, sf):
    return stock.stock_status(fx.orders_table(spark, sf), fx.inventory(spark, sf), STOCK_START, STOCK_END,
                              supplier="SUP3", shipped_only=True)


@plan("g08_stock_totals", oracle=with_views(["fx_inventory"], """
SELECT COUNT(*) AS total_products, CAST(SUM(stock_qty) AS BIGINT) AS total_stock,
  COUNT(CASE WHEN stock_qty > 0 THEN 1 END) AS in_stock, COUNT(CASE WHEN stock_qty = 0 THEN 1 END) AS out_of_stock
FROM fx_inventory"""))
def g08(spark, sf):
    return stock.stock_totals(fx.inventory(spark, sf))


@plan("g09_stock_by_category", oracle=with_views(["fx_inventory"], """
SELECT category, COUNT(*) AS count, CAST(SUM(stock_qty) AS BIGINT) AS stock FROM fx_inventory GROUP BY category"""))
def g09(spark, sf):
    return stock.stock_by_category(fx.inventory(spark, sf))


_LIST_COLS = ("product_code, barcode, product_name, option_name, category, supplier, supplier_option, cost_price, "
              "sell_price, stock_qty, defect_qty")


@plan("l01_stock_list", oracle=with_views(["fx_inventory"], f"""
SELECT {_LIST_COLS} FROM fx_inventory ORDER BY stock_qty DESC, product_code, option_name LIMIT 200"""))
def l01(spark, sf):
    return stock.stock_list(fx.inventory(spark, sf))


@plan("f04_stock_search", oracle=with_views(["fx_inventory"], f"""
SELECT {_LIST_COLS} FROM fx_inventory
WHERE (strpos(lower(product_name), 'blue') > 0 OR strpos(lower(product_code), 'blue') > 0
       OR strpos(lower(barcode), 'blue') > 0) AND stock_qty > 0 AND category = 'SMALL'"""))
def f04(spark, sf):
    return stock.stock_list(fx.inventory(spark, sf), category="SMALL", search="Blue", stock_only=True, limit=None)


@plan("g11_shipped_by_key", oracle=with_views(["fx_orders", "fx_inventory"], """
SELECT 'variant' AS kind, variant_code AS key, prev_v AS prev_qty, per_v AS period_qty FROM bv
UNION ALL SELECT 'name', nk, prev_n, per_n FROM bn""", _maps_sql(STATUS_WINDOWS)))
def g11(spark, sf):
    o, inv = fx.orders_table(spark, sf), fx.inventory(spark, sf)
    base_day = stock.stock_base_date(inv, STOCK_START)
    first_base = F.lit(base_day).cast("date")
    d, s, e = F.col("order_date"), F.lit(STOCK_START).cast("date"), F.lit(STOCK_END).cast("date")
    o = month_prune(o, min(base_day, STOCK_START), STOCK_END)
    bv, bn = stock.shipped_totals(o, {"prev": (d >= first_base) & (d < s), "per": (d >= s) & (d <= e)})
    return (bv.select(F.lit("variant").alias("kind"), F.col("variant_code").alias("key"),
                      F.col("prev_v").alias("prev_qty"), F.col("per_v").alias("period_qty"))
              .unionByName(bn.select(F.lit("name").alias("kind"), F.col("product_name").alias("key"),
                                     F.col("prev_n").alias("prev_qty"), F.col("per_n").alias("period_qty"))))


# ---- stock page (INV) ------------------------------------------------------------

@plan("g19_stock_kpis", oracle=with_views(["fx_orders", "fx_inventory"], """
SELECT COUNT(*) AS total_items, CAST(COALESCE(SUM(outgoing), 0) AS BIGINT) AS total_outgoing,
  COUNT(CASE WHEN opening > 0 AND closing <= 10 AND closing > 0 THEN 1 END) AS low_count,
  COUNT(CASE WHEN closing <= 0 AND opening > 0 THEN 1 END) AS danger_count,
  CAST(COALESCE(SUM(CAST(opening * cost AS DECIMAL(20,2))), 0) AS DOUBLE) AS opening_value FROM page""", PAGE_VIEWS))
def g19(spark, sf):
    return stock.stock_kpis(_page(spark, sf))


_EXPORT_SQL = """SELECT code, barcode, name, option, category, cost, price, opening, outgoing, closing,
  CASE WHEN closing < 0 THEN 'negative' WHEN closing = 0 THEN 'out' WHEN closing <= 10 THEN 'low' ELSE 'ok' END AS status
FROM page"""


@plan("k09_stock_export", oracle=with_views(["fx_orders", "fx_inventory"], _EXPORT_SQL, PAGE_VIEWS))
def k09(spark, sf):
    return stock.stock_export(_page(spark, sf))


@plan("p11_stock_band_counts", oracle=with_views(["fx_orders", "fx_inventory"], f"""
SELECT status, COUNT(*) AS items FROM ({_EXPORT_SQL}) x GROUP BY status""", PAGE_VIEWS))
def p11(spark, sf):
    return stock.stock_export(_page(spark, sf)).groupBy("status").agg(F.count(F.lit(1)).alias("items"))


@plan("f08_band_filter", oracle=with_views(["fx_orders", "fx_inventory"], """
SELECT no, code, name, option, opening, outgoing, closing FROM page
WHERE closing <= 10 AND closing > 0 AND (strpos(lower(name), 'ring') > 0 OR strpos(lower(code), 'ring') > 0
  OR strpos(lower(barcode), 'ring') > 0 OR strpos(lower(option), 'ring') > 0)""", PAGE_VIEWS))
def f08(spark, sf):
    return stock.page_filter(_page(spark, sf), search="ring", band="low") \
        .select("no", "code", "name", "option", "opening", "outgoing", "closing")


@plan("l05_stock_page", oracle=with_views(["fx_orders", "fx_inventory"], """
SELECT no, code, name, opening, outgoing, closing FROM page ORDER BY no LIMIT 100 OFFSET 100""", PAGE_VIEWS))
def l05(spark, sf):
    return _page(spark, sf).orderBy("no").offset(100).limit(100).select(
        "no", "code", "name", "opening", "outgoing", "closing")


@plan("k10_saved_stock", oracle=with_views(["fx_orders", "fx_inventory"], """
SELECT code, opening, outgoing FROM page WHERE opening > 0 OR outgoing > 0""", PAGE_VIEWS))
def k10(spark, sf):
    return stock.saved_stock(_page(spark, sf))


# ---- sheets (S6, S9) and restore (J7) ------------------------------------------------

def _stock_sheet(spark, sf):
    """The stock table as an uploaded sheet: Korean headers, text cells;
    every 3rd row leaves the first stock column empty (second one used)."""
    r = fx.inventory_rows(spark, sf)
    h = SHEET_STOCK_HEADERS
    k = F.col("seq")
    return r.select(
        "seq",
        F.when(k % 7 == 0, F.lit("")).otherwise(F.col("product_code")).alias(h["product_code"]),
        F.col("barcode").alias(h["barcode"]),
        F.when(k % 50 == 0, F.lit("")).otherwise(F.col("product_name")).alias(h["product_name"]),
        F.col("option_name").alias(h["option_name"]), F.col("category").alias(h["category"]),
        F.col("supplier").alias(h["supplier"]), F.col("supplier_option").alias(h["supplier_option"]),
        F.col("cost_price").cast("string").alias(h["cost_price"]),
        F.col("sell_price").cast("string").alias(h["sell_price"]),
        F.when(k % 3 == 0, F.lit("")).otherwise(F.col("stock_qty").cast("string")).alias(h["stock_qty"]),
        F.concat(F.col("stock_qty").cast("string"), F.lit(" ea")).alias(h["stock_qty_alt"]),
        F.col("defect_qty").cast("string").alias(h["defect_qty"]),
    )


@plan("s06_stock_sheet", oracle=with_views(["fx_inventory_rows"], """
SELECT seq, CASE WHEN seq % 7 = 0 THEN barcode ELSE product_code END AS product_code, barcode, product_name,
  option_name, category, supplier, supplier_option, cost_price, sell_price, stock_qty, defect_qty
FROM fx_inventory_rows WHERE seq % 50 <> 0"""))
def s06(spark, sf):
    return stock.parse_stock_sheet(_stock_sheet(spark, sf))


def _opening_raw(spark, sf):
    """The uploaded opening-stock sheet (staged rows), header located."""
    rows = staged(spark, "sheet_opening", [table_path(sf, "part")], lambda: _opening_rows(spark, sf))
    return stock.locate_header(rows, list(OPEN_HEADERS.values()), "pos")


def _saved(spark, sf):
    """The saved stock table (K10 output), as written by the page."""
    inputs = [table_path(sf, t) for t in ("lineitem", "orders", "part", "customer")]
    return staged(spark, "saved_stock", inputs, lambda: stock.saved_stock(_page(spark, sf)))


def _opening_rows(spark, sf):
    """Opening-stock sheet as raw rows: two title rows, the header row, then
    one row per stock row (every 9th without a code)."""
    h = OPEN_HEADERS
    cells = list(h.values())
    r = fx.inventory_rows(spark, sf)
    data = r.select(
        (F.col("seq") + F.lit(10)).alias("pos"),
        F.when(F.col("seq") % 9 == 0, F.lit("")).otherwise(F.concat(F.lit(" "), F.col("product_code"))).alias(h["code"]),
        F.col("barcode").alias(h["barcode"]), F.col("product_name").alias(h["name"]),
        F.col("option_name").alias(h["option"]), F.col("category").alias(h["category"]),
        F.format_number(F.col("cost_price"), 2).alias(h["cost"]),
        F.col("sell_price").cast("string").alias(h["price"]))
    # title and header rows, each a one-row projection of the same table
    one = r.groupBy().agg(F.count(F.lit(1)).alias("_n"))
    title = one.select(F.lit(0).cast("bigint").alias("pos"),
                       *[F.lit("stock list" if i == 0 else None).cast("string").alias(c) for i, c in enumerate(cells)])
    blank = one.select(F.lit(1).cast("bigint").alias("pos"), *[F.lit(None).cast("string").alias(c) for c in cells])
    header = one.select(F.lit(2).cast("bigint").alias("pos"), *[F.lit(c).alias(c) for c in cells])
    return title.unionByName(blank).unionByName(header).unionByName(data)


@plan("s09_opening_sheet", oracle=with_views(["fx_inventory_rows"], """
SELECT row_number() OVER (ORDER BY seq) AS no, product_code AS code, barcode, product_name AS name,
  option_name AS option, category,
  CASE WHEN cost_price >= 1000 THEN CAST(floor(cost_price / 1000) AS DOUBLE) ELSE cost_price END AS cost,
  sell_price AS price
FROM fx_inventory_rows WHERE seq % 9 <> 0"""))
def s09(spark, sf):
    return stock.parse_opening_sheet(_opening_raw(spark, sf)).drop("pos")


RESTORED_SQL = """
SELECT row_number() OVER (ORDER BY r.seq) AS no, r.product_code AS code, r.barcode, r.product_name AS name,
  r.option_name AS option,
  CAST(COALESCE(NULLIF(s.opening, 0), 0) AS BIGINT) AS opening, CAST(COALESCE(NULLIF(s.outgoing, 0), 0) AS BIGINT) AS outgoing,
  CAST(COALESCE(NULLIF(s.opening, 0), 0) - COALESCE(NULLIF(s.outgoing, 0), 0) AS BIGINT) AS closing
FROM fx_inventory_rows r
LEFT JOIN (SELECT code, opening, outgoing FROM page WHERE opening > 0 OR outgoing > 0) s ON r.product_code = s.code
WHERE r.seq % 9 <> 0"""
RESTORED_VIEWS = PAGE_VIEWS + [("restored", RESTORED_SQL)]


def _restored(spark, sf):
    items = stock.parse_opening_sheet(_opening_raw(spark, sf))
    return stock.restore_saved(items, _saved(spark, sf))


@plan("j07_restore_saved", oracle=with_views(["fx_orders", "fx_inventory", "fx_inventory_rows"], """
SELECT no, code, name, opening, outgoing, closing FROM restored""", RESTORED_VIEWS))
def j07(spark, sf):
    return _restored(spark, sf).select("no", "code", "name", "opening", "outgoing", "closing")


def _sync_sql():
    from ledgerline.plans.ingest_plans import A_VIEWS
    items = f"""
SELECT 'P' || l.product_no AS key, l.product_name AS name, 'opt' AS option, l.q AS qty
FROM a_lines l JOIN a_raw r ON r.order_id = l.order_id
WHERE r.date BETWEEN '{STOCK_START}' AND '{STOCK_END}' AND r.status NOT LIKE 'C%' AND r.status NOT LIKE 'R%'"""
    views = A_VIEWS + RESTORED_VIEWS + [
        ("items", items),
        ("agg", "SELECT key, name, option, SUM(qty) AS qty FROM items GROUP BY key, name, option"),
        ("cand", "SELECT a.key, a.name, a.option, p.no FROM agg a JOIN restored p ON (p.barcode <> '' AND p.barcode = a.key) "
                 "OR (p.code <> '' AND p.code = a.key) OR (a.name <> '' AND a.option <> '' AND p.name = a.name "
                 "AND strpos(p.option, a.option) > 0)"),
        ("first_hit", "SELECT key, name, option, MIN(no) AS no FROM cand GROUP BY key, name, option"),
        ("matched", "SELECT f.no, SUM(a.qty) AS add_first FROM agg a JOIN first_hit f ON a.key = f.key "
                    "AND a.name = f.name AND a.option = f.option GROUP BY f.no"),
        ("rest", "SELECT a.name, SUM(a.qty) AS qty FROM agg a LEFT JOIN first_hit f ON a.key = f.key AND a.name = f.name "
                 "AND a.option = f.option WHERE f.no IS NULL AND a.name <> '' GROUP BY a.name"),
        ("contained", "SELECT p.no, SUM(r.qty) AS add_contains FROM restored p JOIN rest r ON strpos(p.name, r.name) > 0 "
                      "GROUP BY p.no"),
    ]
    body = """
SELECT p.no, p.code, p.opening,
  CAST(p.outgoing + COALESCE(m.add_first, 0) + COALESCE(c.add_contains, 0) AS BIGINT) AS outgoing,
  CAST(p.opening - (p.outgoing + COALESCE(m.add_first, 0) + COALESCE(c.add_contains, 0)) AS BIGINT) AS closing
FROM restored p LEFT JOIN matched m ON m.no = p.no LEFT JOIN contained c ON c.no = p.no"""
    return with_views(["fx_orders", "fx_inventory", "fx_inventory_rows"], body, views)


@plan("j06_sync_orders", oracle=_sync_sql())
def j06(spark, sf):
    from ledgerline.sources import feeds
    raw_a = feeds.in_days(feeds.landed_a(spark, sf), STOCK_START, STOCK_END)
    items = stock.sync_items(raw_a, STOCK_START, STOCK_END)
    # the page state after load + restore (J7), as the stored page table
    inputs = [table_path(sf, t) for t in ("lineitem", "orders", "part", "customer")]
    page = staged(spark, "stock_page", inputs, lambda: _restored(spark, sf))
    out = stock.sync_outgoing(page, items)
    return out.select("no", "code", "opening", F.col("outgoing").cast("bigint").alias("outgoing"),
                      F.col("closing").cast("bigint").alias("closing"))
