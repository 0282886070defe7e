"""Registered plans of the collection jobs (T1-T4) and of the export files (K8): each writes
landing folders from the fixture feeds, runs the streams, and returns what is stored."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.operators import claims
from ledgerline.operators import normalize as nz
from ledgerline.plans.ingest_plans import _B_SQL, _C_SQL, A_VIEWS, OUT, _out
from ledgerline.plans.registry import plan
from ledgerline.plans.sink_plans import _fresh, _land, _oid
from ledgerline.sinks import tables as sinks
from ledgerline.sinks.files import total_size
from ledgerline.sources import feeds
from ledgerline.sources.fixtures import with_views
from ledgerline.sources.tables import read_table
from ledgerline.streaming import ingest

FILES = 2               # files of a landing step, and of a trigger, at least
FILE_BYTES = 16 << 20   # of a landing file, compressed, at most about; a larger feed has more files
CUT = "1998-01-01"      # two collections: orders before this day, then the others


def _files(feed) -> int:
    """Files of a landing step, by the size of the landed feed it is taken from."""
    held = feed.inputFiles()
    size = total_size(feed.sparkSession, held[0].split(f"/{feeds.DAY_COLUMN}=")[0]) if held else 0
    return max(FILES, -(-size // FILE_BYTES))


_LAST_DAY = """
SELECT '{n}' AS batch, CAST(m.as_of AS VARCHAR) AS as_of, channel, COUNT(DISTINCT order_id) AS order_count,
  CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total_amount
FROM a_out JOIN (SELECT MAX(order_date) AS as_of FROM a_out WHERE {cut}) m ON order_date BETWEEN m.as_of - INTERVAL 1 DAY AND m.as_of
WHERE NOT status ILIKE 'C%' AND NOT status ILIKE 'R%' GROUP BY m.as_of, channel"""


@plan("t02_last_day_sales", oracle=with_views(["fx_orders"], _LAST_DAY.format(n=0, cut=f"order_date < DATE '{CUT}'")
                                              + " UNION ALL " + _LAST_DAY.format(n=1, cut="TRUE"), A_VIEWS))
def t02_last_day(spark, sf):
    """Two triggers; after each the sales of its last day and the day before, over the stored orders."""
    table, raw = _fresh(spark, "last-day"), feeds.landed_a(spark, sf)
    day, n = F.substring("order_date", 1, 10), _files(raw)
    for part in (raw.where(day < CUT), raw.where(day >= CUT)):
        _land(part, f"{table}_landing", n)
    ingest.order_ingest(spark, f"{table}_landing", table, f"{table}_checkpoint", max_files=n, last_day=f"{table}_last_day").awaitTermination()
    got = spark.read.parquet(f"{table}_last_day")
    return got.select(F.col("batch_id").cast("string").alias("batch"), "as_of", "channel", "order_count", "total_amount")


@plan("t01_backfill", oracle=with_views(["fx_orders"], f"""
SELECT {OUT.replace(' status,', " CASE WHEN CAST(order_id AS BIGINT) % 5 = 0 THEN 'R40' ELSE status END AS status,")} FROM a_out""", A_VIEWS))
def t01_backfill(spark, sf):
    """T1 at start-up: older records are collected again in two windows that share a month, next to
    a stream that already holds later states of some of them; nothing is doubled or reverted."""
    table, raw = _fresh(spark, "backfill"), feeds.landed_a(spark, sf)
    n = _files(raw)
    _land(raw, f"{table}_old")
    _land(raw.where(_oid() % 3 == 0), f"{table}_landing", n)
    _land(raw.where(_oid() % 5 == 0).withColumn("order_status", F.lit("R40")), f"{table}_landing", n)
    ingest.order_ingest(spark, f"{table}_landing", table, f"{table}_checkpoint", max_files=n).awaitTermination()
    for run, (start, end) in enumerate((("1990-01-01", CUT), ("1997-12-01", "2010-12-31"))):
        start, end = ingest.collect_window(end, start=start, end=end, max_days=10_000)
        ingest.collect_days(spark, f"{table}_old", table, start, end, run)
    return _out(sinks.read_orders(spark, table))


@plan("t01_channels_b_c", oracle=with_views(["fx_orders"], f"SELECT {OUT} FROM ({_B_SQL}) b UNION ALL SELECT {OUT} FROM ({_C_SQL}) c"))
def t01_channels(spark, sf):
    """T1 for channels B and C into one table; C's status batches land one after the other."""
    table = _fresh(spark, "channels")
    _land(feeds.feed_b(spark, sf), f"{table}_B")
    c = feeds.feed_c(spark, sf)
    for status in feeds.C_STATUSES:
        _land(c.where(F.col("search_status") == status).drop("search_status"), f"{table}_C/search_status={status}")
    for ch in (nz.CHANNEL_B, nz.CHANNEL_C):
        ingest.order_ingest(spark, f"{table}_{ch}", table, f"{table}_checkpoint/{ch}", channel=ch).awaitTermination()
    return _out(sinks.read_orders(spark, table))


@plan("t04_multi_channel_run", oracle=with_views(["fx_orders"], f"""
SELECT 'A' AS channel, 'success' AS status, COUNT(*) AS saved, (SELECT COUNT(*) FROM a_out) + (SELECT COUNT(*) FROM ({_B_SQL}) b) AS total_saved FROM a_out
UNION ALL SELECT 'B', 'success', COUNT(*), (SELECT COUNT(*) FROM a_out) + COUNT(*) FROM ({_B_SQL}) b
UNION ALL SELECT 'C', 'failed', 0, (SELECT COUNT(*) FROM a_out) + (SELECT COUNT(*) FROM ({_B_SQL}) b)""", A_VIEWS))
def t04_run(spark, sf):
    """T4: one run over three channels, of which one has no landing folder."""
    table = _fresh(spark, "run")
    _land(feeds.landed_a(spark, sf), f"{table}_A")
    _land(feeds.feed_b(spark, sf), f"{table}_B")
    ingest.collect_all(spark, {c: f"{table}_{c}" for c in "ABC"}, table, f"{table}_checkpoint", f"{table}_runs", run=1)
    run = sinks.run_history(spark, f"{table}_runs", None)
    return run.select("total_saved", F.explode("channels").alias("c")).select("c.channel", "c.status", "c.saved", "total_saved")


T03_DAYS = ("2024-01-11", "2024-01-21")


@plan("t03_stream_windows", oracle="""
WITH late AS (SELECT COUNT(*) AS n FROM events WHERE event_id % 50 = 0 AND ts < TIMESTAMP '2024-01-05'),
closed AS (SELECT date_trunc('day', MAX(ts)) - INTERVAL 1 DAY AS until FROM events)
SELECT CAST(date_trunc('day', ts) AS VARCHAR) AS day, event_type, COUNT(*) AS events,
  CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value, (SELECT n FROM late) AS late_rows
FROM events WHERE date_trunc('day', ts) < (SELECT until FROM closed) GROUP BY date_trunc('day', ts), event_type""")
def t03_stream(spark, sf):
    """T3 on a stream of several triggers: repeats are dropped, rows behind the watermark are late and
    counted from the stream's progress, and closed day windows equal the batch ones."""
    ev, path = ingest.event_time(read_table(spark, sf, "events")), _fresh(spark, "events")
    first, second = (F.lit(d).cast("timestamp") for d in T03_DAYS)
    again = ev.where((F.col("event_id") % 7 == 0) & (F.col("ts") >= second))
    late = ev.where((F.col("event_id") % 50 == 0) & (F.col("ts") < F.lit("2024-01-05").cast("timestamp")))
    steps = (ev.where(F.col("ts") < first), ev.where((F.col("ts") >= first) & (F.col("ts") < second)),
             ev.where(F.col("ts") >= second), late.unionByName(again))
    for part in steps:
        part.repartition(FILES).write.mode("append").parquet(path)
    stream = ingest.dedupe_events(ingest.event_stream(spark, path, T.StructType(ev.schema.fields), max_files=FILES))
    q = ingest.start_window_stream(stream, ingest.daily_sales_windows, f"{path}_days", f"{path}_checkpoint")
    q.awaitTermination()
    return spark.read.parquet(f"{path}_days").withColumn("late_rows", F.lit(ingest.late_rows(q)).cast("bigint"))


_LABEL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in claims.STATUS_LABELS.items())


@plan("k08_export_files", oracle=with_views(["fx_orders"], f"""
SELECT shape, order_id, order_date, customer AS buyer, CASE shape WHEN 1 THEN names_slash ELSE names_wide END AS items,
  CAST(qsum AS VARCHAR) AS quantity, CASE status {_LABEL} ELSE status END AS status,
  CASE WHEN okey % 11 = 0 THEN '0' ELSE CAST(CAST(pay AS BIGINT) AS VARCHAR) END AS amount, CASE shape WHEN 2 THEN 'card "x"' END AS payment, TRUE AS marked
FROM (SELECT r.*, date || ' 10:15' AS order_date, w.names_wide FROM a_raw r
      JOIN (SELECT order_id, string_agg(product_name, ' / ' ORDER BY l) AS names_wide FROM a_lines GROUP BY order_id) w USING (order_id)) x,
  (VALUES (1), (2)) s(shape)""", A_VIEWS))
def k08_files(spark, sf):
    """K8: both export shapes as files, each file with a byte-order mark, read back."""
    path, raw = _fresh(spark, "exports"), feeds.landed_a(spark, sf).where(F.size("items") > 0)
    raw = raw.withColumn("payment_method", F.lit('card "x"'))
    shapes = {1: (claims.export_rows(raw), claims.EXPORT_HEADER),
              2: (claims.export_rows(raw, " / ", payment=True), claims.EXPORT_HEADER_PAYMENT)}
    out = None
    for n, (rows, header) in shapes.items():
        sinks.export_csv(rows, f"{path}/{n}", header, bom=True)
        files = spark.read.format("binaryFile").load(f"{path}/{n}")
        marked = files.agg(F.bool_and(F.hex(F.substring("content", 1, 3)) == "EFBBBF")).first()[0]
        back = spark.read.option("header", True).option("escape", '"').option("emptyValue", "").csv(f"{path}/{n}")
        back = back.toDF("order_id", "order_date", "buyer", "items", "quantity", "status", "amount", *["payment"] * (n == 2))
        back = back.withColumns({"shape": F.lit(n), "marked": F.lit(marked)})
        out = back.withColumn("payment", F.lit(None).cast("string")) if out is None else out.unionByName(back)
    return out
