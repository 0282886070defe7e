"""Cost matching and margin reports.

The margin report takes the top ``limit`` sales groups first and only then
matches costs (the order matters for the result).  The cost maps are pruned
to the keys that the top groups can look up -- a semi join against a
broadcast key list of at most ``2 * limit`` values -- before the cascade of
left joins, so the large cost list is streamed once and never shuffled for
the cascade.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.rules import (
    effective_sale, falsy_coalesce, ident, js_rate, js_round, last_wins, money, month_prune, nonempty, or_sql,
    parse_float_sql)

# ---- fixed values -----------------------------------------------------------------
COST_SHEET_POSITIONS = {"code": 0, "barcode": 1, "name": 2, "option": 3, "cost": 4, "sell": 5,
                        "category": 6, "supplier": 9}
MATCH_CODE, MATCH_NONE = "code", "none"
ENTRY_FIELDS = ("cost", "sell", "name", "option", "category")
COST_COLUMNS = ("item_code", "barcode", "item_name", "option_name", "cost_price", "sell_price", "category", "supplier")


# ---- S7 / S8: cost list sources -----------------------------------------------------

def parse_cost_sheet(rows: DataFrame, cells: list[str]) -> DataFrame:
    """Positional cost sheet rows (header already removed, see
    ``stock.locate_header``) -> cost list.  Rows without a code are dropped;
    commas are stripped before the lenient number parse."""
    p = COST_SHEET_POSITIONS

    def c(k):
        return ident(cells[p[k]])

    def text(k):
        return f"trim(coalesce(CAST({c(k)} AS STRING), ''))"

    def num(k):
        v = parse_float_sql(f"regexp_replace(CAST({or_sql(c(k), default='0', kind='cell')} AS STRING), ',', '')")
        return or_sql(v, default=0.0, kind="number")

    return rows.where(f"{c('code')} IS NOT NULL AND {c('code')} != ''").selectExpr(
        *(["pos"] if "pos" in rows.columns else []),
        f"{text('code')} AS item_code", f"{text('barcode')} AS barcode", f"{text('name')} AS item_name",
        f"{text('option')} AS option_name", f"{num('cost')} AS cost_price", f"{num('sell')} AS sell_price",
        f"{text('category')} AS category", f"{text('supplier')} AS supplier")


COST_JSON_SCHEMA = ("code string, barcode string, name string, option string, cost double, sell double, "
                    "category string, supplier string")


def cost_items(items: DataFrame) -> DataFrame:
    """Cost list items (JSON fields code, barcode, name, option, cost,
    sell, category, supplier) -> cost list rows with ``||`` defaults."""
    def text(c):
        return f"CAST({or_sql(c, default='')} AS STRING)"

    def num(c):
        return f"CAST({or_sql(c, default=0.0, kind='number')} AS DOUBLE)"

    return items.selectExpr(
        *(["seq"] if "seq" in items.columns else []),
        f"{text('code')} AS item_code", f"{text('barcode')} AS barcode", f"{text('name')} AS item_name",
        f"{text('option')} AS option_name", f"{num('cost')} AS cost_price", f"{num('sell')} AS sell_price",
        f"{text('category')} AS category", f"{text('supplier')} AS supplier")


def cost_coverage(costs: DataFrame) -> DataFrame:
    """Rows and rows with a positive cost."""
    return costs.agg(F.count(F.lit(1)).alias("count"),
                     F.count(F.when(F.col("cost_price") > 0, 1)).alias("with_cost"))


# ---- J5: cost maps --------------------------------------------------------------------

def _entry() -> Column:
    return F.struct(F.col("cost_price").alias("cost"), F.col("sell_price").alias("sell"),
                    F.col("item_name").alias("name"), F.col("option_name").alias("option"),
                    F.coalesce(F.col("category"), F.lit("")).alias("category"))


def cost_maps(costs: DataFrame, code_keys: DataFrame | None = None,
              barcode_keys: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with a positive cost; the last row (greatest ``seq``) per
    non-empty code and per non-empty barcode.  Returns (by_code, by_barcode)
    with columns (key, entry).

    ``code_keys`` / ``barcode_keys`` (one column ``k``) restrict each map to
    the keys a caller can look up: the cost rows are semi-joined first, so
    only those rows are shuffled for the de-duplication (a key's winner
    depends only on that key's rows)."""
    pos = costs.where(F.col("cost_price") > 0).select("seq", "item_code", "barcode", _entry().alias("entry"))

    def one(col: str, keys: DataFrame | None) -> DataFrame:
        rows = pos.where(F.col(col) != "").select(F.col(col).alias("key"), "seq", "entry")
        if keys is not None:
            rows = rows.join(keys, rows.key == keys.k, "left_semi")
        return last_wins(rows, ["key"], ["seq"]).select("key", "entry")

    return one("item_code", code_keys), one("barcode", barcode_keys)


def _lookup(df: DataFrame, m: DataFrame, on: str, alias: str) -> DataFrame:
    mm = m.select(F.col("key").alias(f"_{alias}_k"), F.col("entry").alias(alias))
    return df.join(mm, df[on] == mm[f"_{alias}_k"], "left").drop(f"_{alias}_k")


# ---- J3: stock -> cost bridge -------------------------------------------------------------

def cost_bridge(inventory: DataFrame, by_code: DataFrame, by_barcode: DataFrame) -> DataFrame:
    """Per supplier option, the cost entry found by code(option),
    barcode(option), barcode(barcode) or barcode(product code), first hit;
    among stock rows with a hit, the last one (``seq``) wins.  Columns:
    supplier_option, entry (with ``inv_name``)."""
    inv = inventory.where(nonempty("supplier_option")).select("seq", "supplier_option", "barcode", "product_code",
                                                              F.col("product_name").alias("inv_name"))
    j = _lookup(inv, by_code, "supplier_option", "c1")
    j = _lookup(j, by_barcode, "supplier_option", "b1")
    j = _lookup(j, by_barcode, "barcode", "b2")
    j = _lookup(j, by_barcode, "product_code", "b3")
    hit = F.coalesce("c1", "b1", "b2", "b3")
    j = j.where(hit.isNotNull()).select(
        "supplier_option", "seq",
        F.struct(*[hit[f].alias(f) for f in ENTRY_FIELDS], F.col("inv_name")).alias("entry"))
    return last_wins(j, ["supplier_option"], ["seq"]).select("supplier_option", "entry")


# ---- G12: margin groups, J4 cascade, margin columns ---------------------------------------

def margin_groups(orders: DataFrame, start: str, end: str, limit: int | None = 100) -> DataFrame:
    """Sales per (name, product no, variant) in the period, effective,
    named; the top ``limit`` by revenue (ties by the group key), or all with None."""
    s = month_prune(orders, start, end).where(
        F.col("order_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
                     & (F.col("product_name") != "") & effective_sale("status"))
    g = s.groupBy("product_name", "product_no", "variant_code").agg(
        F.sum("quantity").cast("bigint").alias("total_qty"),
        F.sum(money("amount")).alias("revenue_dec"),
        F.count(F.lit(1)).alias("order_count"))
    if limit is None:
        return g
    return g.orderBy(F.col("revenue_dec").desc(), "product_name", "product_no", "variant_code").limit(limit)


def match_costs(top: DataFrame, by_code: DataFrame, by_barcode: DataFrame, bridge: DataFrame) -> DataFrame:
    """Variant->code, variant->barcode, variant->bridge, product
    no->code, product no->barcode; first hit wins.  Adds ``matched``
    (entry or null), ``match_rule`` (1-5, 0 = none), ``matched_inv_name``."""
    j = _lookup(top, by_code, "variant_code", "m1")
    j = _lookup(j, by_barcode, "variant_code", "m2")
    br = bridge.select(F.col("supplier_option").alias("key"), F.col("entry"))
    j = _lookup(j, br, "variant_code", "m3")
    j = _lookup(j, by_code, "product_no", "m4")
    j = _lookup(j, by_barcode, "product_no", "m5")
    v, p = nonempty("variant_code"), nonempty("product_no")
    rule = (F.when(v & F.col("m1").isNotNull(), 1).when(v & F.col("m2").isNotNull(), 2)
             .when(v & F.col("m3").isNotNull(), 3).when(p & F.col("m4").isNotNull(), 4)
             .when(p & F.col("m5").isNotNull(), 5).otherwise(0))
    j = j.withColumn("match_rule", rule)

    def pick(field: str) -> Column:
        r = F.col("match_rule")
        return (F.when(r == 1, F.col(f"m1.{field}")).when(r == 2, F.col(f"m2.{field}"))
                 .when(r == 3, F.col(f"m3.{field}")).when(r == 4, F.col(f"m4.{field}"))
                 .when(r == 5, F.col(f"m5.{field}")))

    name = F.when(F.col("match_rule") == 3, falsy_coalesce(F.col("m3.inv_name"), F.col("m3.name"), default=""))
    j = j.select(*top.columns, "match_rule",
                 F.struct(*[pick(f).alias(f) for f in ENTRY_FIELDS]).alias("_e"),
                 F.coalesce(name, pick("name"), F.lit("")).alias("matched_inv_name"))
    return j


REPORT_COLUMNS = ("product_name", "product_no", "variant_code", "matched_inv_name", "category", "total_qty",
                  "total_revenue", "order_count", "cost_price", "sell_price", "total_cost", "margin",
                  "margin_rate", "unit_margin", "match_type", "match_rule")


def margin_report(orders: DataFrame, inventory: DataFrame, costs: DataFrame, start: str, end: str,
                  limit: int | None = 100) -> DataFrame:
    """Top groups, cost cascade, then cost, margin, rate, unit margin.

    The top groups and the pruned cost maps are small (bounded by ``limit``)
    and each feeds several lookups; they are checkpointed to the shared
    checkpoint folder so the lookups read them instead of re-deriving them
    (and the plan does not repeat their lineage)."""
    top = margin_groups(orders, start, end, limit).checkpoint()
    # keys the top groups can look up: at most 2 * limit values (broadcast); without a limit they are joined as any side
    keys = (top.select(F.col("variant_code").alias("k")).unionByName(top.select(F.col("product_no").alias("k")))
               .where(F.col("k") != "").distinct())
    kb = F.broadcast(keys) if limit else keys
    # stock rows that can bridge a top variant, and the barcodes they look up
    inv_k = inventory.join(kb, inventory.supplier_option == kb.k, "left_semi")
    bkeys = (keys.unionByName(inv_k.select(F.col("barcode").alias("k")))
                 .unionByName(inv_k.select(F.col("product_code").alias("k"))).distinct())
    by_code, by_barcode = (m.checkpoint() for m in cost_maps(costs, kb, bkeys))
    bridge = cost_bridge(inv_k, by_code, by_barcode)
    m = match_costs(top, by_code, by_barcode, bridge)

    matched = F.col("match_rule") > 0
    cost = F.when(matched, F.col("_e.cost")).otherwise(F.lit(0.0))
    sell = F.when(matched, F.col("_e.sell")).otherwise(F.lit(0.0))
    total_cost_dec = money(cost) * F.col("total_qty")
    margin_dec = F.col("revenue_dec") - total_cost_dec
    rev = F.col("revenue_dec").cast("double")
    mar = margin_dec.cast("double")
    qty = F.col("total_qty")
    return m.select(
        "product_name", F.coalesce("product_no", F.lit("")).alias("product_no"), "variant_code",
        "matched_inv_name",
        F.when(matched, F.coalesce(F.col("_e.category"), F.lit(""))).otherwise(F.lit("")).alias("category"),
        "total_qty", rev.alias("total_revenue"), "order_count",
        cost.alias("cost_price"), sell.alias("sell_price"),
        total_cost_dec.cast("double").alias("total_cost"), mar.alias("margin"),
        F.when(rev > 0, js_rate(mar, rev)).otherwise(F.lit(0.0)).alias("margin_rate"),
        F.when(qty > 0, js_round(rev / qty - cost)).otherwise(F.lit(0)).cast("bigint").alias("unit_margin"),
        F.when(matched, F.lit(MATCH_CODE)).otherwise(F.lit(MATCH_NONE)).alias("match_type"),
        "match_rule")


def margin_summary(report: DataFrame) -> DataFrame:
    """Totals over the report rows and over matched rows only."""
    m = F.col("match_type") != MATCH_NONE

    def dsum(c, cond=None):
        x = money(F.col(c)) if cond is None else F.when(cond, money(F.col(c)))
        return F.coalesce(F.sum(x), F.lit(0))

    agg = report.agg(dsum("total_revenue").alias("rev"), dsum("total_cost").alias("cost"),
                     dsum("total_revenue", m).alias("mrev"), dsum("total_cost", m).alias("mcost"),
                     F.count(F.when(m, 1)).alias("matched_products"),
                     F.count(F.when(~m, 1)).alias("unmatched_products"))

    def rate(margin, revenue):
        return F.when(revenue > 0, js_rate(margin, revenue)).otherwise(F.lit(0.0))

    rev, cost = F.col("rev").cast("double"), F.col("cost").cast("double")
    mrev, mcost = F.col("mrev").cast("double"), F.col("mcost").cast("double")
    tm = (F.col("rev") - F.col("cost")).cast("double")
    mm = (F.col("mrev") - F.col("mcost")).cast("double")
    return agg.select(rev.alias("total_revenue"), cost.alias("total_cost"), tm.alias("total_margin"),
                      rate(tm, rev).alias("margin_rate"), mrev.alias("matched_revenue"),
                      mcost.alias("matched_cost"), mm.alias("matched_margin"),
                      rate(mm, mrev).alias("matched_margin_rate"), "matched_products", "unmatched_products")
