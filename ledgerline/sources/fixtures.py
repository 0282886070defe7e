"""Fixture views over the driver tables (see FIXTURES.md §B).

The order-line, stock and cost tables of the data model are derived from the
TPC-H-like base tables.  Each view exists twice: as a DataFrame builder for
the Spark side, and as SQL text for the DuckDB oracle (``with_views``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.rules import last_wins
from ledgerline.sources.staging import staged
from ledgerline.sources.tables import read_table, session_key, table_path

# Fixed values of the fixture model.
CHANNELS = ("mall", "market", "store")
STOCK_BASE_DATE = "2001-01-01"


_VIEWS: dict[tuple, DataFrame] = {}


def _memo(fn):
    """Reuse the built view per (session, sf_dir, args): the views are pure
    functions of read-only tables, and reusing the object spares the
    analyzer from re-resolving the same subtree for every report."""
    import functools

    @functools.wraps(fn)
    def wrapper(spark, sf_dir, *args, **kw):
        key = (fn.__name__, session_key(spark), sf_dir, args, tuple(sorted(kw.items())))
        df = _VIEWS.get(key)
        if df is None:
            df = fn(spark, sf_dir, *args, **kw)
            _VIEWS[key] = df
        return df
    return wrapper


def _channel(key: Column) -> Column:
    k = key % 3
    return F.when(k == 0, "mall").when(k == 1, "market").otherwise("store")


def _joined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collected lines, repeats included, as the few columns that the others are made of.

    Orders meet their customer before the lines, and lines their product before
    the order, so that the lines are shuffled by the order key last."""
    li = (read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_returnflag", "l_shipdate"))
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    o = o.join(c, F.col("o_custkey") == c.c_custkey)
    li = li.join(p, F.col("l_partkey") == p.p_partkey)
    key = F.col("o_orderkey")
    k3 = key % 3
    rf, os_ = F.col("l_returnflag"), F.col("o_orderstatus")
    status = (F.when(rf == "R", F.when(k3 == 0, "R40").when(k3 == 1, "RETURNED").otherwise("refund"))
               .when((rf == "A") & (os_ == "F"), F.when(k3 == 0, "C40").otherwise("CANCELED"))
               .when((rf == "A") & (os_ == "O"), "E40")
               .when(os_ == "F", "N40").when(os_ == "P", "N20").otherwise("N10"))
    return li.join(o, F.col("l_orderkey") == key).select(
        key.alias("_ok"), F.col("l_linenumber").alias("_ln"), F.col("l_shipdate").alias("collected_at"),
        F.col("l_partkey").alias("tie1"), F.col("l_suppkey").alias("tie2"), F.col("l_extendedprice").alias("tie3"),
        F.col("o_orderdate").cast("date").alias("order_date"), status.alias("status"), F.col("p_name").alias("product_name"),
        F.col("l_quantity").cast("bigint").alias("quantity"), F.col("c_name").alias("customer"))


def _line_columns() -> list[Column]:
    """``ORDER_COLUMNS`` from those of ``_joined_lines``."""
    key, part = F.col("_ok"), F.col("tie1").cast("string")
    return [
        F.concat(_channel(key), F.lit("_"), key.cast("string"), F.lit("_"), F.col("_ln").cast("string")).alias("id"),
        _channel(key).alias("channel"), key.cast("string").alias("order_id"), F.col("order_date"), F.col("status"),
        F.col("product_name"), part.alias("product_no"),
        F.when(F.col("tie2") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("V"), part)).alias("variant_code"),
        F.col("quantity"), F.col("tie3").alias("amount"), F.col("customer")]


@_memo
def order_lines(spark: SparkSession, sf_dir: str, keys: bool = False) -> DataFrame:
    """``fx_order_lines``: lines as collected, repeats included.  ``keys``
    adds the numeric line key (``_ok``, ``_ln``) the string id is built from."""
    extra = ["_ok", "_ln"] if keys else []
    return _joined_lines(spark, sf_dir).select(*extra, *_line_columns(), "collected_at", "tie1", "tie2", "tie3")


ORDER_COLUMNS = ("id", "channel", "order_id", "order_date", "status", "product_name",
                 "product_no", "variant_code", "quantity", "amount", "customer")


def upsert_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fx_orders`` computed: the latest line per id (the K1 upsert rule).

    The id is a one-to-one function of (order key, line number), so the
    latest row is taken per numeric key, with the same clustering as the order
    join that feeds it, and the text columns are made afterwards: they follow from the key and the ``order``."""
    return _latest(_joined_lines(spark, sf_dir))


def _latest(lines: DataFrame) -> DataFrame:
    return last_wins(lines, ["_ok", "_ln"], ["collected_at", "tie1", "tie2", "tie3"]).select(*_line_columns())


def stored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``upsert_lines`` with one row per id: lines without a number have no id and count as one."""
    lines, has_id = _joined_lines(spark, sf_dir), F.col("_ln").isNotNull()
    return _latest(lines.where(has_id)).unionByName(last_wins(_latest(lines.where(~has_id)), ["id"], []))


@_memo
def orders_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fx_orders``: the stored order-line table (``upsert_lines`` staged),
    written by the K1 sink, so date windows prune its month folders."""
    from ledgerline.sinks import tables as sinks
    inputs = [table_path(sf_dir, t) for t in ("lineitem", "orders", "part", "customer")]
    return staged(spark, "fx_orders", inputs, read=lambda path: sinks.read_orders(spark, path),
                  write=lambda path: sinks.upsert_orders(spark, path, stored_lines(spark, sf_dir), order=None))


@_memo
def inventory_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fx_inventory_rows``: stock sheet rows in sheet order ``seq``."""
    p = read_table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        k.alias("seq"),
        F.concat(F.lit("P"), k.cast("string")).alias("product_code"),
        F.concat(F.lit("880"), F.lpad(k.cast("string"), 9, "0")).alias("barcode"),
        F.col("p_name").alias("product_name"),
        F.concat(F.col("p_brand"), F.lit("/"), (F.col("p_size") % 10).cast("string")).alias("option_name"),
        F.col("p_type").alias("category"),
        F.when(k % 11 == 0, F.lit("")).otherwise(F.concat(F.lit("SUP"), (k % 10).cast("string"))).alias("supplier"),
        F.when(k % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("V"), k.cast("string"))).alias("supplier_option"),
        F.round(F.col("p_retailprice") * 0.6, 2).alias("cost_price"),
        F.col("p_retailprice").alias("sell_price"),
        ((k * 37) % 401).cast("bigint").alias("stock_qty"),
        (k % 3).cast("bigint").alias("defect_qty"),
        F.lit(STOCK_BASE_DATE).cast("date").alias("base_date"),
    )


INVENTORY_COLUMNS = ("product_code", "barcode", "product_name", "option_name", "category", "supplier",
                     "supplier_option", "cost_price", "sell_price", "stock_qty", "defect_qty", "base_date")


def replace_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fx_inventory`` computed: the last sheet row per (name, option) (K2)."""
    return last_wins(inventory_rows(spark, sf_dir), ["product_name", "option_name"], ["seq"]) \
        .select("seq", *INVENTORY_COLUMNS)


@_memo
def inventory(spark: SparkSession, sf_dir: str, keep_seq: bool = False) -> DataFrame:
    """``fx_inventory``: the stored stock table; ``keep_seq`` keeps the sheet
    row order of the surviving row."""
    df = staged(spark, "fx_inventory", [table_path(sf_dir, "part")], lambda: replace_stock(spark, sf_dir))
    return df.select(*(("seq",) + INVENTORY_COLUMNS if keep_seq else INVENTORY_COLUMNS))


@_memo
def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fx_costs``: cost list with repeated codes, empty barcodes, zero costs."""
    p = read_table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    m4, m10 = k % 4, k % 10
    base_cost = F.round(F.col("p_retailprice") * 0.6, 2)
    first = p.where(k % 13 != 0).select(
        k.alias("seq"),
        F.when(m4 == 0, F.concat(F.lit("V"), k.cast("string"))).when(m4 == 2, k.cast("string"))
         .otherwise(F.concat(F.lit("EC"), k.cast("string"))).alias("item_code"),
        F.when(m10 == 0, F.lit("")).when(m10 == 1, F.concat(F.lit("V"), k.cast("string")))
         .when(m10 == 3, k.cast("string")).when(m10 == 7, F.concat(F.lit("P"), k.cast("string")))
         .otherwise(F.concat(F.lit("880"), F.lpad(k.cast("string"), 9, "0"))).alias("barcode"),
        F.col("p_name").alias("item_name"), F.col("p_brand").alias("option_name"),
        F.when(k % 17 == 0, F.lit(0.0)).otherwise(base_cost).alias("cost_price"),
        F.col("p_retailprice").alias("sell_price"), F.col("p_type").alias("category"),
        F.col("p_brand").alias("supplier"),
    )
    second = p.where((k % 20).isin(4, 6)).select(
        (F.lit(1000000000) + k).alias("seq"),
        F.concat(F.lit("V"), k.cast("string")).alias("item_code"), F.lit("").alias("barcode"),
        F.col("p_name").alias("item_name"), F.col("p_brand").alias("option_name"),
        (base_cost + 1).alias("cost_price"), F.col("p_retailprice").alias("sell_price"),
        F.col("p_type").alias("category"), F.col("p_brand").alias("supplier"),
    )
    return first.unionByName(second)


# --------------------------------------------------------------------------
# SQL text of the same views, for the DuckDB oracle.
# --------------------------------------------------------------------------

VIEW_SQL: dict[str, str] = {
    "fx_order_lines": """
SELECT concat(CASE o_orderkey % 3 WHEN 0 THEN 'mall_' WHEN 1 THEN 'market_' ELSE 'store_' END, CAST(o_orderkey AS VARCHAR), '_', CAST(l_linenumber AS VARCHAR)) AS id,
  CASE o_orderkey % 3 WHEN 0 THEN 'mall' WHEN 1 THEN 'market' ELSE 'store' END AS channel,
  CAST(o_orderkey AS VARCHAR) AS order_id,
  CAST(o_orderdate AS DATE) AS order_date,
  CASE WHEN l_returnflag = 'R' THEN CASE o_orderkey % 3 WHEN 0 THEN 'R40' WHEN 1 THEN 'RETURNED' ELSE 'refund' END
       WHEN l_returnflag = 'A' AND o_orderstatus = 'F' THEN CASE o_orderkey % 3 WHEN 0 THEN 'C40' ELSE 'CANCELED' END
       WHEN l_returnflag = 'A' AND o_orderstatus = 'O' THEN 'E40'
       WHEN o_orderstatus = 'F' THEN 'N40' WHEN o_orderstatus = 'P' THEN 'N20' ELSE 'N10' END AS status,
  p_name AS product_name, CAST(p_partkey AS VARCHAR) AS product_no,
  CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE concat('V', CAST(p_partkey AS VARCHAR)) END AS variant_code,
  CAST(l_quantity AS BIGINT) AS quantity, l_extendedprice AS amount, c_name AS customer,
  l_shipdate AS collected_at, l_partkey AS tie1, l_suppkey AS tie2, l_extendedprice AS tie3
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey""",
    "fx_orders": """
SELECT id, channel, order_id, order_date, status, product_name, product_no, variant_code, quantity, amount, customer
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY collected_at DESC, tie1 DESC, tie2 DESC, tie3 DESC) AS rn FROM fx_order_lines) t WHERE rn = 1""",
    "fx_inventory_rows": """
SELECT p_partkey AS seq, concat('P', CAST(p_partkey AS VARCHAR)) AS product_code, concat('880', lpad(CAST(p_partkey AS VARCHAR), 9, '0')) AS barcode,
  p_name AS product_name, concat(p_brand, '/', CAST(p_size % 10 AS VARCHAR)) AS option_name, p_type AS category,
  CASE WHEN p_partkey % 11 = 0 THEN '' ELSE concat('SUP', CAST(p_partkey % 10 AS VARCHAR)) END AS supplier,
  CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat('V', CAST(p_partkey AS VARCHAR)) END AS supplier_option,
  round(p_retailprice * 0.6, 2) AS cost_price, p_retailprice AS sell_price,
  CAST((p_partkey * 37) % 401 AS BIGINT) AS stock_qty, CAST(p_partkey % 3 AS BIGINT) AS defect_qty, DATE '2001-01-01' AS base_date
FROM part""",
    "fx_inventory": """
SELECT product_code, barcode, product_name, option_name, category, supplier, supplier_option, cost_price, sell_price, stock_qty, defect_qty, base_date
FROM (SELECT *, row_number() OVER (PARTITION BY product_name, option_name ORDER BY seq DESC) AS rn FROM fx_inventory_rows) t WHERE rn = 1""",
    "fx_costs": """
SELECT p_partkey AS seq,
  CASE p_partkey % 4 WHEN 0 THEN concat('V', CAST(p_partkey AS VARCHAR)) WHEN 2 THEN CAST(p_partkey AS VARCHAR) ELSE concat('EC', CAST(p_partkey AS VARCHAR)) END AS item_code,
  CASE p_partkey % 10 WHEN 0 THEN '' WHEN 1 THEN concat('V', CAST(p_partkey AS VARCHAR)) WHEN 3 THEN CAST(p_partkey AS VARCHAR) WHEN 7 THEN concat('P', CAST(p_partkey AS VARCHAR))
    ELSE concat('880', lpad(CAST(p_partkey AS VARCHAR), 9, '0')) END AS barcode,
  p_name AS item_name, p_brand AS option_name,
  CASE WHEN p_partkey % 17 = 0 THEN 0.0e0 ELSE round(p_retailprice * 0.6, 2) END AS cost_price, p_retailprice AS sell_price, p_type AS category, p_brand AS supplier
FROM part WHERE p_partkey % 13 <> 0
UNION ALL
SELECT 1000000000 + p_partkey, concat('V', CAST(p_partkey AS VARCHAR)), '', p_name, p_brand, round(p_retailprice * 0.6, 2) + 1, p_retailprice, p_type, p_brand FROM part WHERE p_partkey % 20 IN (4, 6)""",
}

VIEW_DEPS: dict[str, tuple[str, ...]] = {
    "fx_order_lines": (),
    "fx_orders": ("fx_order_lines",),
    "fx_inventory_rows": (),
    "fx_inventory": ("fx_inventory_rows",),
    "fx_costs": (),
}


def with_views(views, body: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``body`` with ``WITH`` clauses for ``views`` (and their inputs)
    followed by ``extra`` (name, sql) pairs."""
    ordered: list[str] = []

    def visit(v):
        for d in VIEW_DEPS[v]:
            visit(d)
        if v not in ordered:
            ordered.append(v)

    for v in views:
        visit(v)
    parts = [f"{v} AS ({VIEW_SQL[v].strip()})" for v in ordered]
    parts += [f"{n} AS ({s.strip()})" for n, s in (extra or [])]
    if not parts:
        return body.strip()
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()
