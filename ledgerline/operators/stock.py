"""Stock reports: shipped-quantity lookup, stock status, snapshots, lists,
KPIs, bands and sheet parsing (S6, S9, J1, J2, J7, K6/K9/K10 content,
G8-G11, G19-G21, L1, L3, L4, P11, P12, F4-F8).

All "lookup map" steps of the source are equi-joins against aggregated
order totals (one row per key, so no row multiplication); the choice of
broadcast vs. shuffle join is left to AQE's measured sizes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.rules import (
    col_, date_text, effective_sale, falsy_coalesce, ident, lit_sql, month_prune, numbered, or_sql,
    parse_float_sql, parse_int_sql, search_any)

# ---- fixed values ----------------------------------------------------------
# Stock-sheet header names (S6) and their fields.
STOCK_SHEET_HEADERS = {
    "product_code": "상품코드", "barcode": "바코드", "product_name": "상품명", "option_name": "옵션",
    "category": "카테고리", "supplier": "공급처", "supplier_option": "공급처옵션", "cost_price": "원가",
    "sell_price": "판매가", "stock_qty": "가용재고", "stock_qty_alt": "정상+창고 가용재고",
    "defect_qty": "불량재고",
}
# Opening-stock sheet header names.
OPENING_SHEET_HEADERS = {
    "code": "품목코드", "barcode": "바코드", "name": "품목명", "option": "옵션명",
    "category": "카테고리", "cost": "입고단가", "price": "출고단가",
}
HEADER_MARKER = "품목코드"
LOW_STOCK = 10
# Stock-band labels (P11) and safety-band order (L4).
BAND_NEGATIVE, BAND_OUT, BAND_LOW, BAND_OK = "negative", "out", "low", "ok"
SAFETY_ORDER = {"out": 0, "low": 1, "ok": 2}


# ---- S6: stock sheet ---------------------------------------------------------

def parse_stock_sheet(sheet: DataFrame) -> DataFrame:
    """Stock sheet (header row by name, all cells text) -> stock rows.

    Code falls back to barcode, stock to the second stock column; rows
    without a name are dropped.  Numbers are read leniently.
    """
    h = STOCK_SHEET_HEADERS

    def cell(k):
        return ident(h[k]) if h[k] in sheet.columns else "CAST(NULL AS STRING)"

    def text(k):
        return f"coalesce(CAST({cell(k)} AS STRING), '')"

    def num(fn, *ks, default):
        return f"coalesce({fn(or_sql(*[cell(k) for k in ks], kind='cell'))}, {default})"

    out = sheet.selectExpr(
        *(["seq"] if "seq" in sheet.columns else []),
        f"coalesce({or_sql(cell('product_code'), cell('barcode'), kind='cell')}, '') AS product_code",
        *[f"{text(k)} AS {k}" for k in ("barcode", "product_name", "option_name", "category", "supplier",
                                        "supplier_option")],
        f"{num(parse_float_sql, 'cost_price', default='0.0')} AS cost_price",
        f"{num(parse_float_sql, 'sell_price', default='0.0')} AS sell_price",
        f"{num(parse_int_sql, 'stock_qty', 'stock_qty_alt', default='CAST(0 AS BIGINT)')} AS stock_qty",
        f"{num(parse_int_sql, 'defect_qty', default='CAST(0 AS BIGINT)')} AS defect_qty")
    return out.where("product_name != ''")


# ---- S7/S9: header row located in the first rows ---------------------------

def locate_header(raw: DataFrame, cells: list[str], pos: str = "pos", file: str | None = None) -> DataFrame:
    """Keep the rows after the header row of each file.

    ``raw`` has text cells ``cells`` and an order column ``pos``.  The header
    is the first row, at any depth, that contains the marker text in any
    cell; if none does, the first row.  One file: two
    scalar subqueries; many files (``file`` column): per-file aggregates
    joined back on the file.
    """
    has_marker = F.lit(False)
    for c in cells:
        has_marker = has_marker | F.coalesce(F.col(c).cast("string").contains(HEADER_MARKER), F.lit(False))
    if file is None:
        first = raw.select(F.min(pos)).scalar()
        head = raw.where(has_marker).select(F.min(pos)).scalar()
        return raw.where(F.col(pos) > F.coalesce(head, first))
    firsts = raw.groupBy(file).agg(F.min(pos).alias("_first"))
    ranked = raw.join(firsts, file)
    heads = (ranked.where(has_marker).groupBy(file).agg(F.min(pos).alias("_hdr")))
    return (ranked.join(heads, file, "left").where(F.col(pos) > F.coalesce("_hdr", "_first"))
                  .drop("_first", "_hdr"))


def parse_opening_sheet(raw: DataFrame, header: dict[str, str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Opening-stock sheet -> numbered items (``no``), rows without a
    code dropped.  ``raw``: text columns named by ``header`` values, in file
    order, header row already removed (see ``locate_header``).  With ``keep`` these
    columns are passed on and the items are left to be numbered by them."""
    h = header or OPENING_SHEET_HEADERS

    def text(k):
        return f"trim(coalesce(CAST({ident(h[k])} AS STRING), ''))"

    def num(k):
        return f"coalesce({parse_float_sql(or_sql(ident(h[k]), kind='cell'))}, 0.0)"

    items = raw.where(f"{ident(h['code'])} IS NOT NULL AND {ident(h['code'])} != ''").selectExpr(
        *(keep or (["pos"] if "pos" in raw.columns else [])),
        *[f"{text(k)} AS {k}" for k in ("code", "barcode", "name", "option", "category")],
        f"{num('cost')} AS cost", f"{num('price')} AS price")
    return numbered(items, "pos", "no") if "pos" in raw.columns and not keep else items


# ---- G11: shipped quantities ------------------------------------------------

def shipped_totals(orders: DataFrame, windows: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Per variant code (non-empty) and per product name: effective shipped
    quantity inside each named window (conditional sums, one scan).

    Returns (by_variant, by_name) with columns ``<window>_v`` / ``<window>_n``.
    """
    eff = orders.where(effective_sale("status"))
    any_w = F.lit(False)
    for w in windows.values():
        any_w = any_w | w
    eff = eff.where(any_w)

    def sums(suffix):
        return [F.sum(F.when(w, F.col("quantity"))).cast("bigint").alias(f"{k}_{suffix}") for k, w in windows.items()]

    by_variant = eff.where(F.col("variant_code") != "").groupBy("variant_code").agg(*sums("v"))
    by_name = eff.groupBy("product_name").agg(*sums("n"))
    return by_variant, by_name


def attach_shipped(stock: DataFrame, by_variant: DataFrame, by_name: DataFrame) -> DataFrame:
    """Stock rows get the variant totals on ``supplier_option`` and the
    name totals on ``product_name`` (left joins on aggregated maps)."""
    v = by_variant.withColumnRenamed("variant_code", "_vk")
    n = by_name.withColumnRenamed("product_name", "_nk")
    out = (stock.join(v, stock.supplier_option == v._vk, "left")
                .join(n, stock.product_name == n._nk, "left"))
    return out.drop("_vk", "_nk")


def pick_shipped(window: str) -> Column:
    """Variant total if the row has a supplier option and the total is
    truthy, else the name total if truthy, else 0 (JS ``||`` chain)."""
    v = f"CASE WHEN supplier_option IS NOT NULL AND supplier_option != '' THEN {window}_v END"
    return F.expr(f"CAST({or_sql(v, f'{window}_n', default=0, kind='number')} AS BIGINT)")


def shipped_source(window: str) -> Column:
    return F.expr(f"CASE WHEN supplier_option IS NOT NULL AND supplier_option != '' AND {window}_v != 0 "
                  f"THEN 'variant' WHEN {window}_n != 0 THEN 'name' ELSE 'zero' END")


def stock_filters(inv: DataFrame, search: str | None = None, supplier: str | None = None,
                  category: str | None = None, search_cols=("product_name", "product_code")) -> DataFrame:
    """case-insensitive literal search over ``search_cols``; supplier
    and category equality."""
    out = inv.where(search_any(list(search_cols), search))
    if supplier:
        out = out.where(F.col("supplier") == supplier)
    if category:
        out = out.where(F.col("category") == category)
    return out


# ---- J1 / K6: daily snapshot ------------------------------------------------

SNAPSHOT_COLUMNS = ("date", "product_code", "product_name", "option_name", "base_stock", "shipped",
                    "expected_stock", "supplier", "category")


def daily_snapshot(orders: DataFrame, inventory: DataFrame, day: str, with_source: bool = False) -> DataFrame:
    """J1/K6 content: every stock row with the quantity shipped on ``day``
    (variant match first, then name, else 0) and the expected stock."""
    d = F.lit(day).cast("date")
    by_v, by_n = shipped_totals(month_prune(orders, day, day), {"day": F.col("order_date") == d})
    j = attach_shipped(inventory, by_v, by_n)
    shipped = pick_shipped("day")
    base = F.coalesce(F.col("stock_qty"), F.lit(0)).cast("bigint")
    cols = [F.lit(day).alias("date"), "product_code", "product_name", "option_name",
            base.alias("base_stock"), shipped.alias("shipped"), (base - shipped).alias("expected_stock"),
            F.coalesce("supplier", F.lit("")).alias("supplier"), F.coalesce("category", F.lit("")).alias("category")]
    if with_source:
        cols.append(shipped_source("day").alias("shipped_source"))
    return j.select(*cols)


def snapshot_shipped_totals(orders: DataFrame, day: str) -> DataFrame:
    """K6 return value ``totalShipped``, split: the sum over the variant map
    and over the name map (their sum double-counts; both are exposed)."""
    d = F.lit(day).cast("date")
    by_v, by_n = shipped_totals(month_prune(orders, day, day), {"day": F.col("order_date") == d})
    tv = by_v.agg(F.sum("day_v").cast("bigint").alias("shipped_by_variant"))
    tn = by_n.agg(F.sum("day_n").cast("bigint").alias("shipped_by_name"))
    u = (tv.select("shipped_by_variant", F.lit(None).cast("bigint").alias("shipped_by_name"))
           .unionByName(tn.select(F.lit(None).cast("bigint").alias("shipped_by_variant"), "shipped_by_name")))
    return u.agg(F.coalesce(F.max("shipped_by_variant"), F.lit(0)).alias("shipped_by_variant"),
                 F.coalesce(F.max("shipped_by_name"), F.lit(0)).alias("shipped_by_name")) \
        .withColumn("total_shipped", F.col("shipped_by_variant") + F.col("shipped_by_name"))


def snapshot_list(snapshot: DataFrame, search: str | None = None, shipped_only: bool = False,
                  supplier: str | None = None, category: str | None = None, limit: int | None = None) -> DataFrame:
    """L3: snapshot rows filtered, shipped desc then opening desc."""
    out = stock_filters(snapshot, search, supplier, category)
    if shipped_only:
        out = out.where(F.col("shipped") > 0)
    out = out.orderBy(F.col("shipped").desc(), F.col("base_stock").desc(), "product_code", "option_name")
    return out.limit(limit) if limit else out


def snapshot_summary(snapshot: DataFrame, supplier: str | None = None, category: str | None = None) -> DataFrame:
    """Counts and sums of a snapshot, moved = rows with shipped > 0."""
    s = stock_filters(snapshot, None, supplier, category)
    return s.agg(F.count(F.lit(1)).alias("total_products"),
                 F.sum("base_stock").cast("bigint").alias("total_base_stock"),
                 F.sum("shipped").cast("bigint").alias("total_shipped"),
                 F.sum("expected_stock").cast("bigint").alias("total_expected"),
                 F.count(F.when(F.col("shipped") > 0, 1)).alias("moved_products"))


def filter_lists(table: DataFrame) -> DataFrame:
    """Distinct non-empty suppliers and categories as (kind, value)."""
    sup = table.where(F.col("supplier") != "").select(F.lit("supplier").alias("kind"), F.col("supplier").alias("value"))
    cat = table.where(F.col("category") != "").select(F.lit("category").alias("kind"), F.col("category").alias("value"))
    return sup.unionByName(cat).distinct().orderBy("kind", "value")


# ---- J2: stock status for a period -------------------------------------------

STATUS_COLUMNS = ("product_code", "product_name", "option_name", "supplier", "category", "base_stock",
                  "shipped", "expected_stock")


def stock_base_date(inv: DataFrame, start: str) -> str:
    """Base date of the first stock row in stock order (greatest stock, then
    code), else ``start``.  One value, read on the driver so that the order
    scan can be bounded by it."""
    row = inv.select(F.max_by(F.col("base_date"), F.struct("stock_qty", "product_code")).cast("string")).first()
    return row[0] if row and row[0] else start


def stock_status_rows(orders: DataFrame, inventory: DataFrame, start: str, end: str,
                       search=None, supplier=None, category=None, extra: Sequence[str] = ()) -> DataFrame:
    """J2 rows; ``extra`` columns of the stock table are passed on."""
    inv = stock_filters(inventory, search, supplier, category)
    base_day = stock_base_date(inv, start)
    base = F.lit(base_day).cast("date")
    d = F.col("order_date")
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    # the base date is a literal, so only the months from it to the period
    # end are read (partition pruning) instead of the whole order history
    by_v, by_n = shipped_totals(month_prune(orders, min(base_day, start), end),
                                {"prev": (d >= base) & (d < s), "per": (d >= s) & (d <= e)})
    j = attach_shipped(inv, by_v, by_n)
    upload = F.coalesce(F.col("stock_qty"), F.lit(0)).cast("bigint")
    prev, per = pick_shipped("prev"), pick_shipped("per")
    return j.select(
        "product_code", "product_name", "option_name", "supplier", "category",
        (upload - prev).alias("base_stock"), per.alias("shipped"), (upload - prev - per).alias("expected_stock"),
        shipped_source("per").alias("shipped_source"),
        F.col("base_date"), *extra)


def stock_status(orders: DataFrame, inventory: DataFrame, start: str, end: str, search=None, supplier=None,
                 category=None, shipped_only: bool = False, limit: int | None = None) -> DataFrame:
    """J2 items: opening = upload - shipped in [base, start); shipped in
    [start, end]; expected = opening - shipped.  Sorted shipped desc, opening
    desc; ``shipped_only`` and ``limit`` apply after the summary."""
    rows = stock_status_rows(orders, inventory, start, end, search, supplier, category)
    if shipped_only:
        rows = rows.where(F.col("shipped") > 0)
    rows = rows.select(*STATUS_COLUMNS, "shipped_source").orderBy(
        F.col("shipped").desc(), F.col("base_stock").desc(), "product_code", "option_name")
    return rows.limit(limit) if limit else rows


def stock_status_summary(orders: DataFrame, inventory: DataFrame, start: str, end: str, search=None,
                         supplier=None, category=None) -> DataFrame:
    """J2 summary over all filtered rows (before shipped-only / limit)."""
    rows = stock_status_rows(orders, inventory, start, end, search, supplier, category)
    inv = stock_filters(inventory, search, supplier, category)
    return rows.agg(
        F.lit(start).alias("start_date"), F.lit(end).alias("end_date"),
        F.lit(stock_base_date(inv, start)).alias("base_date"),
        F.count(F.lit(1)).alias("total_products"),
        F.coalesce(F.sum("base_stock"), F.lit(0)).cast("bigint").alias("total_base_stock"),
        F.coalesce(F.sum("shipped"), F.lit(0)).cast("bigint").alias("total_shipped"),
        F.coalesce(F.sum("expected_stock"), F.lit(0)).cast("bigint").alias("total_expected"),
        F.count(F.when(F.col("shipped") > 0, 1)).alias("moved_products"))


# ---- G8 / G9 / L1: stock table -------------------------------------------------

def stock_totals(inventory: DataFrame) -> DataFrame:
    """Rows, total stock, in stock (> 0), out of stock (= 0)."""
    return inventory.agg(F.count(F.lit(1)).alias("total_products"),
                         F.sum("stock_qty").cast("bigint").alias("total_stock"),
                         F.count(F.when(F.col("stock_qty") > 0, 1)).alias("in_stock"),
                         F.count(F.when(F.col("stock_qty") == 0, 1)).alias("out_of_stock"))


def stock_by_category(inventory: DataFrame) -> DataFrame:
    """Rows and stock per category, by stock descending."""
    return (inventory.groupBy("category")
            .agg(F.count(F.lit(1)).alias("count"), F.sum("stock_qty").cast("bigint").alias("stock"))
            .orderBy(F.col("stock").desc(), "category"))


LIST_COLUMNS = ("product_code", "barcode", "product_name", "option_name", "category", "supplier",
                "supplier_option", "cost_price", "sell_price", "stock_qty", "defect_qty")


def stock_list(inventory: DataFrame, category: str | None = None, search: str | None = None,
               stock_only: bool = False, limit: int | None = 200) -> DataFrame:
    """L1: filters (F4 name/code/barcode search, F5 in stock, F6 category),
    stock descending, limit (API default 200)."""
    out = stock_filters(inventory, search, None, category, ("product_name", "product_code", "barcode"))
    if stock_only:
        out = out.where(F.col("stock_qty") > 0)
    out = out.select(*LIST_COLUMNS).orderBy(F.col("stock_qty").desc(), "product_code", "option_name")
    return out.limit(limit) if limit else out


# ---- stock page: opening / outgoing / closing (INV) ------------------------------

def stock_band(closing="closing") -> Column:
    """Negative / out / low (<= 10) / ok."""
    c = col_(closing)
    return (F.when(c < 0, BAND_NEGATIVE).when(c == 0, BAND_OUT).when(c <= LOW_STOCK, BAND_LOW)
             .otherwise(BAND_OK))


def band_filter(page: DataFrame, band: str | None) -> DataFrame:
    """F8: out (= 0), low (1..10), neg (< 0), ok (> 10)."""
    c = F.col("closing")
    conds = {"out": c == 0, "low": (c <= LOW_STOCK) & (c > 0), "neg": c < 0, "ok": c > LOW_STOCK}
    return page.where(conds[band]) if band else page


def page_filter(page: DataFrame, search: str | None = None, category: str | None = None,
                band: str | None = None) -> DataFrame:
    """F4 (name, code, barcode, option) + F6 + F8 on the stock page."""
    out = page.where(search_any(["name", "code", "barcode", "option"], search))
    if category:
        out = out.where(F.col("category") == category)
    return band_filter(out, band)


def restore_saved(items: DataFrame, saved: DataFrame) -> DataFrame:
    """Saved (code, opening, outgoing) restored by code onto sheet items;
    closing = opening - outgoing.  Items without a saved row start at 0."""
    s = saved.select(F.col("code").alias("_code"), F.col("opening").alias("_o"), F.col("outgoing").alias("_g"))
    j = items.join(s, items.code == s._code, "left")
    o = falsy_coalesce(F.col("_o"), default=0, kind="number").cast("bigint")
    g = falsy_coalesce(F.col("_g"), default=0, kind="number").cast("bigint")
    return j.withColumn("opening", o).withColumn("outgoing", g) \
        .withColumn("closing", F.col("opening") - F.col("outgoing")).drop("_code", "_o", "_g")


def saved_stock(page: DataFrame) -> DataFrame:
    """K10 content: non-zero rows by code, the later row of a code wins."""
    from ledgerline.functions.rules import last_wins
    nz = page.where((F.col("opening") > 0) | (F.col("outgoing") > 0)).select("code", "no", "opening", "outgoing")
    return last_wins(nz, ["code"], ["no"]).select("code", "opening", "outgoing")


def stock_kpis(page: DataFrame) -> DataFrame:
    """Items, outgoing, low (0 < closing <= 10 with opening), at risk
    (closing <= 0 with opening), opening value (opening x cost)."""
    o, c = F.col("opening"), F.col("closing")
    return page.agg(F.count(F.lit(1)).alias("total_items"),
                    F.coalesce(F.sum("outgoing"), F.lit(0)).cast("bigint").alias("total_outgoing"),
                    F.count(F.when((o > 0) & (c <= LOW_STOCK) & (c > 0), 1)).alias("low_count"),
                    F.count(F.when((c <= 0) & (o > 0), 1)).alias("danger_count"),
                    F.coalesce(F.sum((o * F.col("cost")).cast("decimal(20,2)")), F.lit(0)).cast("double")
                     .alias("opening_value"))


EXPORT_COLUMNS = ("code", "barcode", "name", "option", "category", "cost", "price", "opening", "outgoing",
                  "closing", "status")


def stock_export(page: DataFrame) -> DataFrame:
    """K9 content: 11 columns with the band label."""
    return page.withColumn("status", stock_band("closing")).select(*EXPORT_COLUMNS)


# ---- P6 / P12 / L4: catalogue stock and safety bands -------------------------------

def safety_band(total="quantity", safety="safety_inventory") -> Column:
    """Out (0), low (<= safety), ok."""
    t, s = col_(total), col_(safety)
    return F.when(t == 0, "out").when(t <= s, "low").otherwise("ok")


def availability_pct(total="quantity", safety="safety_inventory") -> Column:
    """min(total / safety * 100, 100); 100 when safety is 0."""
    t, s = col_(total).cast("double"), col_(safety).cast("double")
    return F.when(s > 0, F.least(t / s * F.lit(100.0), F.lit(100.0))).otherwise(F.lit(100.0))


def safety_report(variants: DataFrame, band: str | None = None) -> DataFrame:
    """P12 + F8 + L4: band and availability per variant, filtered by band,
    ordered out < low < ok (then by code)."""
    out = variants.withColumn("st", safety_band()).withColumn("availability", availability_pct())
    if band and band != "all":
        out = out.where(F.col("st") == band)
    order = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SAFETY_ORDER.items() for x in kv]),
                                    F.col("st")), F.lit(len(SAFETY_ORDER)))
    return out.orderBy(order, "variant_code")


# ---- J6: order items -> stock rows ---------------------------------------------------------------

def sync_items(orders_a: DataFrame, start: str, end: str) -> DataFrame:
    """Items of channel-A orders dated in ``[start, end]`` whose status does
    not start with C or R (case-sensitive), reduced to their match inputs:
    (key, name, option, qty).  key = product code, else variant code, else
    name; qty = parseInt(quantity || 1)."""
    day = "substring(coalesce(order_date, ''), 1, 10)"
    st = "coalesce(order_status, '')"
    o = orders_a.where(f"{day} BETWEEN {lit_sql(start)} AND {lit_sql(end)} AND NOT {st} LIKE 'C%' "
                       f"AND NOT {st} LIKE 'R%'")
    return o.selectExpr("explode(items) AS it").selectExpr(
        f"{or_sql('it.product_code', 'it.variant_code', 'it.product_name', default='')} AS key",
        "coalesce(it.product_name, '') AS name", "coalesce(it.option_value, '') AS option",
        f"{parse_int_sql(or_sql('it.quantity', default='1'))} AS qty")


def sync_outgoing(page: DataFrame, items: DataFrame) -> DataFrame:
    """Add item quantities to the stock page's outgoing.

    An item goes to the first row (lowest ``no``) whose barcode or code
    equals the item key, or whose name equals the item name and whose option
    contains the item option.  An item without such a row adds its quantity
    to every row whose name contains the item name.

    Items are pre-aggregated per match input, so the work grows with the
    distinct inputs, not with order volume.  The "contains" fallback is an
    exact equi-join: every row name is expanded into its substrings whose
    lengths occur among the unmatched item names, and those are joined to
    the item names -- no nested-loop join and no cap on candidates.
    """
    agg = items.groupBy("key", "name", "option").agg(F.sum("qty").alias("qty"))
    inv = page.select("no", "code", "barcode", F.col("name").alias("inv_name"), F.col("option").alias("inv_option"))

    def first_of(col):
        return inv.where(F.col(col) != "").groupBy(F.col(col).alias("key")).agg(F.min("no").alias("no"))

    by_barcode = agg.join(first_of("barcode"), "key").select("key", "name", "option", "no")
    by_code = agg.join(first_of("code"), "key").select("key", "name", "option", "no")
    # repeated names: the first row of every name and option, met once by every item name and option
    named = inv.groupBy("inv_name", "inv_option").agg(F.min("no").alias("no"))
    asked = agg.where((F.col("name") != "") & (F.col("option") != "")).select(F.col("name").alias("_n"), F.col("option").alias("_o")).distinct()
    hits = (asked.join(named, F.col("_n") == F.col("inv_name")).where(F.col("inv_option").contains(F.col("_o")))
                 .groupBy("_n", "_o").agg(F.min("no").alias("no")))
    by_name = agg.join(hits, (F.col("name") == F.col("_n")) & (F.col("option") == F.col("_o"))).select("key", "name", "option", "no")
    first = (by_barcode.unionByName(by_code).unionByName(by_name)
             .groupBy("key", "name", "option").agg(F.min("no").alias("no")))
    matched = agg.join(first, ["key", "name", "option"]).groupBy("no").agg(F.sum("qty").alias("add_first"))

    rest = (agg.join(first, ["key", "name", "option"], "left_anti").where(F.col("name") != "")
               .groupBy("name").agg(F.sum("qty").alias("qty")))
    # the distinct lengths of the unmatched names (a scalar subquery: at most
    # the longest name length values), materialised as a column before the
    # higher-order functions use it
    lens = rest.select(F.array_sort(F.collect_set(F.length("name")))).scalar()
    n = F.length("inv_name")
    # a repeated name is cut and matched once
    inv_b = inv.select("inv_name").distinct().withColumn("_lens", F.coalesce(lens, F.array().cast("array<int>")))
    lengths = F.filter(F.col("_lens"), lambda ln: (ln >= 1) & (ln <= n))
    subs = inv_b.select("inv_name", F.explode(F.flatten(F.transform(
        lengths,
        lambda ln: F.transform(F.sequence(F.lit(1), n - ln + 1), lambda i: F.substring("inv_name", i, ln))))
    ).alias("sub")).where(F.col("sub").isNotNull()).distinct()
    per_name = subs.join(rest, subs.sub == rest.name).groupBy("inv_name").agg(F.sum("qty").alias("_add"))
    contained = inv.select("no", "inv_name").distinct().join(per_name, "inv_name").groupBy("no").agg(F.sum("_add").alias("add_contains"))

    out = (page.join(matched, "no", "left").join(contained, "no", "left")
               .withColumn("outgoing", F.col("outgoing") + F.coalesce("add_first", F.lit(0))
                           + F.coalesce("add_contains", F.lit(0)))
               .withColumn("closing", F.col("opening") - F.col("outgoing"))
               .drop("add_first", "add_contains"))
    return out
