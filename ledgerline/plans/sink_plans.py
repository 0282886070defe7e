"""Registered plans that write through the sinks into a fresh folder of the
shared store and return what is read back (K1-K10, L6, P5, T1, T4, G6, G21, G24).
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerline.operators import analytics as an
from ledgerline.operators import margin, sales, stock
from ledgerline.plans.ingest_plans import A_VIEWS, OUT, _out
from ledgerline.plans.margin_plans import _COST_OUT
from ledgerline.plans.registry import plan
from ledgerline.plans.stock_plans import _EXPORT_SQL, PAGE_VIEWS, SNAPSHOT_VIEWS, _page, _snapshot
from ledgerline.session import checkpoint_dir
from ledgerline.sinks import tables as sinks
from ledgerline.sinks.order_table import COMPRESSION
from ledgerline.sources import feeds, sheets
from ledgerline.sources import fixtures as fx
from ledgerline.sources.fixtures import with_views
from ledgerline.streaming import ingest


def _fresh(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/ledgerline-plans/{name}-{uuid.uuid4().hex[:12]}"


def _oid():
    return F.col("order_id").cast("bigint")


@plan("k01_upsert_stored", oracle=with_views(["fx_orders"], """
SELECT id, channel, order_id,
  CAST(CASE WHEN CAST(order_id AS BIGINT) % 20 = 10 AND CAST(order_id AS BIGINT) % 7 <> 0 THEN NULL ELSE order_date END AS VARCHAR) AS order_date,
  status, product_name, product_no, variant_code, quantity, amount, customer FROM fx_orders"""))
def k01_stored(spark, sf):
    """K1: a first batch with undated and wrongly dated lines, then the right
    lines of some of them, twice (a retry)."""
    path = _fresh(spark, "orders")
    fx.upsert_lines(spark, sf).withColumn("ingest_seq", F.lit(0)).write.option("compression", COMPRESSION).parquet(f"{path}_collected")
    lines = spark.read.parquet(f"{path}_collected")
    early = F.when(_oid() % 10 == 0, F.lit(None)).when(_oid() % 7 == 0, F.date_add("order_date", 40)).otherwise(F.col("order_date"))
    sinks.upsert_orders(spark, path, lines.withColumn("order_date", early))
    right = lines.where((_oid() % 20 == 0) | (_oid() % 7 == 0))
    for _ in range(2):
        sinks.upsert_orders(spark, path, right)
    return _out(sinks.read_orders(spark, path))


@plan("k02_stock_stored", oracle=with_views(["fx_inventory"], """
SELECT product_code, barcode, product_name, option_name, category, supplier, supplier_option, cost_price,
  sell_price, stock_qty, defect_qty, CAST(base_date AS VARCHAR) AS base_date FROM fx_inventory"""))
def k02_stored(spark, sf):
    """K2: sheet rows with repeated keys replace the stored stock table."""
    path, rows = _fresh(spark, "stock"), fx.inventory_rows(spark, sf)
    for part in (rows.where("seq % 3 = 0"), rows):
        sinks.replace_stock(part, path, fx.STOCK_BASE_DATE)
    return spark.read.parquet(path).drop("seq").withColumn("base_date", F.col("base_date").cast("string"))


@plan("k03_k04_costs_stored", oracle=with_views(["fx_costs"], f"""
SELECT {_COST_OUT} FROM fx_costs UNION ALL SELECT {_COST_OUT} FROM fx_costs WHERE seq % 2 = 0"""))
def k03_stored(spark, sf):
    """K3 twice (a replace keeps nothing), then K4 appends half of the list again."""
    path, c = _fresh(spark, "costs"), fx.costs(spark, sf)
    rows = c.select(*margin.COST_COLUMNS)
    for _ in range(2):
        sinks.replace_costs(rows, path)
    sinks.append_costs(c.where("seq % 2 = 0").select(*margin.COST_COLUMNS), path)
    return spark.read.parquet(path)


@plan("k05_summary_stored", oracle=with_views(["fx_orders"], """
SELECT CAST(order_date AS VARCHAR) AS date, channel, COUNT(DISTINCT order_id) AS order_count
FROM fx_orders WHERE order_date IS NOT NULL AND channel IN ('mall', 'store') GROUP BY order_date, channel"""))
def k05_stored(spark, sf):
    """K5: the summaries of two channels; one of them is refreshed."""
    path, o = _fresh(spark, "summary"), fx.orders_table(spark, sf)
    old = sales.daily_summary(o, "mall").limit(3)
    sinks.refresh_daily_summary(old.unionByName(sales.daily_summary(o, "store")), path)
    sinks.refresh_daily_summary(sales.daily_summary(o, "mall"), path)
    return spark.read.parquet(path).select("date", "channel", "order_count")


@plan("k06_snapshot_stored", oracle=with_views(["fx_orders", "fx_inventory"], """
SELECT product_code, option_name, MIN(base_stock) AS base_stock FROM snap GROUP BY product_code, option_name""", SNAPSHOT_VIEWS))
def k06_stored(spark, sf):
    """K6: a day's snapshot, rebuilt; one row per (date, code, option)."""
    path, s = _fresh(spark, "snapshot"), _snapshot(spark, sf)
    for part in (s.limit(10), s.unionByName(s)):
        sinks.write_snapshot(part, path)
    return spark.read.parquet(path).select("product_code", "option_name", "base_stock")


@plan("g21_stored_snapshots", oracle=with_views(["fx_orders"], """
SELECT CAST(order_date AS VARCHAR) AS date FROM (SELECT DISTINCT order_date FROM fx_orders) d ORDER BY order_date DESC LIMIT 30"""))
def g21_stored(spark, sf):
    """G21 over a written snapshot table with one row for each order date and code."""
    path, o = _fresh(spark, "snapshots"), fx.orders_table(spark, sf)
    rows = o.groupBy(F.col("order_date").cast("string").alias("date"), F.col("product_no").alias("product_code")).agg(
        F.sum("quantity").alias("shipped"))
    sinks.write_snapshot(rows, path)
    days = spark.read.parquet(path).select(F.col("snapshot_date").cast("string").alias("date")).distinct()
    return days.orderBy(F.col("date").desc()).limit(30)


def _runs(spark, sf, path: str):
    """Run records of every order date, written through K7; a retried batch replaces its record."""
    o = fx.orders_table(spark, sf)
    day = o.groupBy("order_date", "channel").agg(F.count(F.lit(1)).alias("n"))
    failed = F.dayofmonth("order_date") == 13
    metric = F.struct("channel", F.when(failed, "failed").otherwise("success").alias("status"), F.lit("").alias("error"),
                      F.col("n").alias("count"), F.col("n").alias("saved"), F.lit(1).cast("bigint").alias("latency"))
    run = day.groupBy("order_date").agg(F.sum("n").alias("total_count"), F.sort_array(F.collect_list(metric)).alias("channels"))
    rows = run.select(F.lit("orders").alias("source"), F.date_format("order_date", "yyyyMM").cast("bigint").alias("batch_id"),
                      F.col("order_date").cast("string").alias("timestamp"), "total_count", "channels")
    for _ in range(2):
        sinks.record_run(rows, path)
    return rows


@plan("k07_l06_run_history", oracle=with_views(["fx_orders"], """
SELECT CAST(order_date AS VARCHAR) AS timestamp, CAST(COUNT(*) AS BIGINT) AS total_count, CAST(COUNT(DISTINCT channel) AS BIGINT) AS channels
FROM fx_orders WHERE order_date IS NOT NULL GROUP BY order_date ORDER BY order_date DESC LIMIT 70"""))
def l06_stored(spark, sf):
    """The newest 70 run records."""
    path = _fresh(spark, "runs")
    _runs(spark, sf, path)
    return sinks.run_history(spark, path, 70).select("timestamp", "total_count", F.size("channels").cast("bigint").alias("channels"))


@plan("g06_stats_with_history", oracle=with_views(["fx_orders", "fx_inventory"], """
SELECT (SELECT COUNT(DISTINCT order_id) FROM fx_orders) AS total_orders,
  (SELECT CAST(MIN(order_date) AS VARCHAR) FROM fx_orders) AS date_from, (SELECT CAST(MAX(order_date) AS VARCHAR) FROM fx_orders) AS date_to,
  (SELECT COUNT(DISTINCT order_date) FROM fx_orders) AS collect_history, (SELECT COUNT(*) FROM fx_inventory) AS inventory_products"""))
def g06_history(spark, sf):
    """G6 with the stored run history."""
    path = _fresh(spark, "runs")
    _runs(spark, sf, path)
    return sales.store_stats(fx.orders_table(spark, sf), fx.inventory(spark, sf), sinks.run_history(spark, path, None))


@plan("g24_failed_channels", oracle=with_views(["fx_orders"], """
SELECT CAST(SUM(CASE WHEN day(order_date) <> 13 THEN n ELSE 0 END) AS BIGINT) AS total_count,
  CAST(SUM(CASE WHEN day(order_date) <> 13 THEN n ELSE 0 END) AS BIGINT) AS total_saved,
  COUNT(CASE WHEN day(order_date) = 13 THEN 1 END) AS failed_channels, COUNT(*) AS channels
FROM (SELECT order_date, channel, COUNT(*) AS n FROM fx_orders WHERE order_date IS NOT NULL GROUP BY order_date, channel) x"""))
def g24_failed(spark, sf):
    """G24 over stored run records, some of whose channels failed."""
    path = _fresh(spark, "runs")
    _runs(spark, sf, path)
    metrics = sinks.run_history(spark, path, None).select(F.explode("channels").alias("m")).select("m.*")
    return an.run_totals(metrics)


@plan("k09_export_file", oracle=with_views(["fx_orders", "fx_inventory"], f"SELECT code, closing, status FROM ({_EXPORT_SQL}) x", PAGE_VIEWS))
def k09_file(spark, sf):
    """K9: the export as CSV files, read back."""
    path = _fresh(spark, "export")
    sinks.export_csv(stock.stock_export(_page(spark, sf)), path)
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return back.select(F.coalesce("code", F.lit("")).alias("code"), F.col("closing").cast("bigint").alias("closing"), "status")


@plan("k10_latest_saved", oracle=with_views(["fx_orders", "fx_inventory"], """
SELECT code, opening, outgoing FROM page WHERE opening > 0 OR outgoing > 0""", PAGE_VIEWS))
def k10_stored(spark, sf):
    """Saved for two days, the later one saved twice; "latest" is read."""
    path, s = _fresh(spark, "saved"), stock.saved_stock(_page(spark, sf))
    sinks.save_stock(s.limit(5), path, "2001-03-30")
    for _ in range(2):
        sinks.save_stock(s, path, "2001-03-31")
    return sinks.latest_saved(spark, path)


def _land(df, path: str, files: int | None = None) -> None:
    """A landing step: ``files`` files, where triggers are counted by files; else as the rows are read."""
    rows = df if files is None else df.repartition(files)
    rows.write.mode("append").option("compression", feeds.COMPRESSION).json(path)


def _collected(spark, sf) -> str:
    """A landing folder of channel A: the feed, then files of changed orders and of records
    without an order id; each step in as many files as tasks read the feed."""
    path, raw = _fresh(spark, "landing"), feeds.landed_a(spark, sf)
    _land(raw, path)
    _land(raw.where(_oid() % 5 == 0).withColumn("order_status", F.lit("R40")), path)
    _land(raw.where(_oid() % 9 == 0).drop("order_id", "order_no"), path)
    return path


@plan("t01_order_ingest", oracle=with_views(["fx_orders"], f"""
SELECT {OUT.replace(' status,', " CASE WHEN CAST(order_id AS BIGINT) % 5 = 0 THEN 'R40' ELSE status END AS status,")} FROM a_out""", A_VIEWS))
def t01(spark, sf):
    """The stream over the landing folder, several files in one trigger;
    equal to the batch upsert in arrival order."""
    table = _fresh(spark, "stream-orders")
    ingest.order_ingest(spark, _collected(spark, sf), table, f"{table}_checkpoint").awaitTermination()
    return _out(sinks.read_orders(spark, table))


@plan("p05_t04_rejects_and_runs", oracle=with_views(["fx_orders"], """
SELECT 'rejects' AS what, CAST(COUNT(*) AS BIGINT) AS n FROM a_out WHERE CAST(order_id AS BIGINT) % 9 = 0
UNION ALL SELECT 'saved', CAST(COUNT(*) AS BIGINT) FROM a_out""", A_VIEWS))
def p05(spark, sf):
    """P5: rejected lines are kept; T4: the run record has the lines saved."""
    table = _fresh(spark, "stream-orders")
    ingest.order_ingest(spark, _collected(spark, sf), table, f"{table}_checkpoint", history=f"{table}_runs").awaitTermination()
    rejects = spark.read.parquet(f"{table}_rejects").agg(F.lit("rejects").alias("what"), F.count(F.lit(1)).alias("n"))
    saved = spark.read.parquet(f"{table}_runs").agg(F.lit("saved").alias("what"), F.sum("total_saved").cast("bigint").alias("n"))
    return rejects.unionByName(saved)


# ---- sheets and cost lists read from files (S6-S9) -----------------------------------------------

FILES = 4


def _upload(df, path: str, cells: list[str], before: list[list[str | None]], seq: str = "seq") -> str:
    """``FILES`` CSV files of the rows, each with the rows ``before`` it, in order."""
    data = df.select((F.col(seq) % FILES).alias("b"), (F.col(seq) + 10).alias("pos"), *cells)
    top = data.select("b").distinct()
    for n, row in enumerate(before):
        data = data.unionByName(top.select("b", F.lit(n).cast("bigint").alias("pos"),
                                           *[F.lit(v).cast("string").alias(c) for c, v in zip(cells, row)]))
    (data.repartition(FILES, "b").sortWithinPartitions("b", "pos").select("b", *cells)
     .write.partitionBy("b").option("escape", '"').option("emptyValue", "").csv(path))
    return path


@plan("s06_stock_sheet_files", oracle=with_views(["fx_inventory_rows"], """
SELECT CASE WHEN seq % 7 = 0 THEN barcode ELSE product_code END AS product_code, barcode, product_name,
  option_name, category, supplier, supplier_option, cost_price, sell_price, stock_qty, defect_qty
FROM fx_inventory_rows WHERE seq % 50 <> 0"""))
def s06_files(spark, sf):
    """S6 from several CSV files with a header row."""
    from ledgerline.plans.stock_plans import _stock_sheet
    path, sheet = _fresh(spark, "sheet-stock"), _stock_sheet(spark, sf)
    sheet.drop("seq").repartition(3).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    return sheets.read_stock_sheet(spark, path)


@plan("s07_cost_sheet_files", oracle=with_views(["fx_costs"], f"SELECT {_COST_OUT} FROM fx_costs WHERE item_code <> ''"))
def s07_files(spark, sf):
    """S7 from several CSV files, each with seven title rows and a header row."""
    c = fx.costs(spark, sf)
    cells = [f"c{i}" for i in range(10)]
    rows = c.select("seq", F.col("item_code").alias("c0"), F.col("barcode").alias("c1"), F.col("item_name").alias("c2"),
                    F.col("option_name").alias("c3"), F.format_number("cost_price", 2).alias("c4"),
                    F.col("sell_price").cast("string").alias("c5"), F.col("category").alias("c6"), F.lit("x").alias("c7"),
                    F.lit("").alias("c8"), F.col("supplier").alias("c9"))
    title = [["cost list" if i == 2 else "-" for i in range(10)]] * 7
    path = _upload(rows, _fresh(spark, "sheet-costs"), cells, [*title, [stock.HEADER_MARKER, *cells[1:]]])
    return sheets.read_cost_sheet(spark, path)


@plan("s08_cost_json_files", oracle=with_views(["fx_costs"], f"SELECT {_COST_OUT} FROM fx_costs"))
def s08_files(spark, sf):
    """JSON files read and stored through K3 (replace) and K4 (append)."""
    path, c = _fresh(spark, "cost-json"), fx.costs(spark, sf)
    posted = c.select("seq", F.col("item_code").alias("code"), "barcode", F.col("item_name").alias("name"),
                      F.col("option_name").alias("option"), F.col("cost_price").alias("cost"), F.col("sell_price").alias("sell"),
                      "category", "supplier")
    for n in (0, 1):
        posted.where(F.col("seq") % 2 == n).drop("seq").write.json(f"{path}/{n}")
    sinks.replace_costs(sheets.read_cost_json(spark, f"{path}/0"), f"{path}-table")
    sinks.append_costs(sheets.read_cost_json(spark, f"{path}/1"), f"{path}-table")
    return spark.read.parquet(f"{path}-table")


@plan("s09_opening_sheet_files", oracle=with_views(["fx_inventory_rows"], """
SELECT product_code AS code, barcode, product_name AS name, option_name AS option, category,
  CASE WHEN cost_price >= 1000 THEN CAST(floor(cost_price / 1000) AS DOUBLE) ELSE cost_price END AS cost, sell_price AS price
FROM fx_inventory_rows WHERE seq % 9 <> 0"""))
def s09_files(spark, sf):
    """S9 from several CSV files; columns by the header's names."""
    names = list(stock.OPENING_SHEET_HEADERS.values())
    r = fx.inventory_rows(spark, sf)
    code = F.when(F.col("seq") % 9 == 0, F.lit("")).otherwise(F.concat(F.lit(" "), F.col("product_code")))
    cols = [code, F.col("barcode"), F.col("product_name"), F.col("option_name"), F.col("category"),
            F.format_number("cost_price", 2), F.col("sell_price").cast("string")]
    cells = [f"c{i}" for i in range(len(names))]
    order = [3, 0, 1, 2, 6, 5, 4]           # the sheet's own column order
    rows = r.select("seq", *[cols[j].alias(cells[i]) for i, j in enumerate(order)])
    path = _upload(rows, _fresh(spark, "sheet-opening"), cells,
                   [["stock list", *["-"] * (len(names) - 1)], [names[j] for j in order]])
    return sheets.read_opening_sheet(spark, path).drop("no")


@plan("s09_opening_sheet_wide", oracle=with_views(["fx_inventory_rows"], """
SELECT product_code AS code, barcode, product_name AS name, option_name AS option, category, cost_price AS cost, sell_price AS price
FROM fx_inventory_rows"""))
def s09_wide(spark, sf):
    """S9 with unnamed columns in front, so that all named ones come after place 10."""
    names = list(stock.OPENING_SHEET_HEADERS.values())
    r = fx.inventory_rows(spark, sf)
    cols = [F.col("product_code"), F.col("barcode"), F.col("product_name"), F.col("option_name"), F.col("category"),
            F.col("cost_price").cast("string"), F.col("sell_price").cast("string")]
    front = 12
    cells = [f"c{i}" for i in range(front + len(names))]
    rows = r.select("seq", *[F.lit("x").alias(c) for c in cells[:front]], *[x.alias(c) for x, c in zip(cols, cells[front:])])
    path = _upload(rows, _fresh(spark, "sheet-opening"), cells, [[*[f"extra {i}" for i in range(front)], *names]])
    return sheets.read_opening_sheet(spark, path).drop("no")


@plan("s09_numbered_files", oracle=with_views(["fx_inventory_rows"], f"""
SELECT row_number() OVER (ORDER BY seq % {FILES}, seq) AS no, product_code AS code, option_name AS option
FROM fx_inventory_rows WHERE seq % 9 <> 0"""))
def s09_numbered(spark, sf):
    """S9's row numbers over several files, each split over tasks."""
    names = list(stock.OPENING_SHEET_HEADERS.values())
    r = fx.inventory_rows(spark, sf)
    cols = [F.when(F.col("seq") % 9 == 0, F.lit("")).otherwise(F.col("product_code")), F.col("barcode"), F.col("product_name"),
            F.col("option_name"), F.col("category"), F.col("cost_price").cast("string"), F.col("sell_price").cast("string")]
    cells = [f"c{i}" for i in range(len(names))]
    path = _upload(r.select("seq", *[x.alias(c) for x, c in zip(cols, cells)]), _fresh(spark, "sheet-numbered"), cells, [names])
    return sheets.read_opening_sheet(spark, path).select("no", "code", "option")
