"""Streaming jobs.

* T1 -- continuous order ingest: one file-source stream per channel over its
  landing folder; each micro-batch is normalised (P1-P4), upserted into the
  order table (K1), the channel's daily summary is recomputed for the months
  the batch touched (K5; cancellations lower the sums, which an append-mode
  aggregate could not retract) and a run record is appended (K7/T4).  The upsert is idempotent, so a batch replayed
  after a failure leaves the same table.
  ``collect_days`` collects a day range once more next to the stream (start-up windows).
* T2 -- after each batch, the exact sales of the last day over the stored orders (``report_last_day``); and sales per hour over the last day: tumbling day windows and sliding
  one-day windows every hour on the event stream, with a watermark.
* T3 -- late data and repeats: ``withWatermark`` + ``dropDuplicatesWithinWatermark``
  on the event id; status changes of an order go through T1's upsert.
* T4 -- run metrics written from ``foreachBatch`` with the batch id as key; ``collect_all`` runs all
  channels and writes one record for them.

``window`` needs TIMESTAMP: event time columns are cast first (the driver
tables store TIMESTAMP_NTZ).
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.rules import day_sql
from ledgerline.operators import normalize as nz
from ledgerline.operators.sales import sales_by_channel
from ledgerline.sinks import tables as sinks
from ledgerline.sources import feeds

RUN_COLUMNS = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("batch_id", T.LongType()),
    T.StructField("trigger", T.StringType()), T.StructField("timestamp", T.StringType()),
    T.StructField("duration", T.LongType()), T.StructField("total_count", T.LongType()),
    T.StructField("total_saved", T.LongType()),
    T.StructField("channels", T.ArrayType(T.StructType([
        T.StructField("channel", T.StringType()), T.StructField("status", T.StringType()),
        T.StructField("error", T.StringType()), T.StructField("count", T.LongType()),
        T.StructField("saved", T.LongType()), T.StructField("latency", T.LongType())]))),
])


# Where a row comes from, in arrival order: later files, and later rows of a file, win.
ARRIVAL = ("_time", "_file", "_block", "_row")


def with_arrival(raw: DataFrame) -> DataFrame:
    """Add what orders rows read from files by arrival: modification time,
    file, and block of the file (the row's place in the block is added per batch)."""
    return raw.select("*", F.col("_metadata.file_modification_time").alias("_time"), F.col("_metadata.file_path").alias("_file"),
                      F.col("_metadata.file_block_start").alias("_block"))


def _normalized(raw: DataFrame, channel: str) -> DataFrame:
    """Lines of one channel, ``ingest_seq`` a struct of the arrival order."""
    arrival = "named_struct(" + ", ".join(f"'{c}', {c}" for c in ARRIVAL) + ")"
    if channel == nz.CHANNEL_A:
        return nz.normalize_a(raw, channel, ingest_seq=arrival)
    if channel == nz.CHANNEL_B:
        return nz.normalize_b(raw, channel, ingest_seq=arrival)
    return nz.normalize_c(raw, feeds.C_STATUSES, channel, ingest_seq=arrival)


def ingest_batch(spark: SparkSession, raw: DataFrame, batch_id: int, table: str, summary: str | None,
                 history: str | None, channel: str = nz.CHANNEL_A, source: str | None = None,
                 rejects_path: str | None = None, last_day: str | None = None, backfill: bool = False) -> dict:
    """One micro-batch of T1: normalise, upsert, refresh summary, record.

    ``raw`` carries the arrival order (``with_arrival``): inside the batch the
    row that arrived last wins.  Records without an order id are kept in the
    batch's folder under ``rejects_path``.  A failure is recorded and raised
    again, so the stream keeps its offset and the batch is retried; rejects and the run
    record are keyed by the batch id, so a retry replaces them.

    A stored line keeps the time its file arrived (``ingest_seq``, microseconds).  With ``backfill`` a
    line replaces only one that arrived before it.  ``last_day``: the table of T2's reports (``report_last_day``)."""
    t0 = time.time()
    source = source or f"orders-{channel}"
    # rows of a block are read in order by one task
    lines, rejects = nz.split_rejects(_normalized(raw.withColumn("_row", F.monotonically_increasing_id()), channel))
    counts, n_rejects, error = {"batch_rows": 0, "batch_lines": 0, "rows_written": 0}, 0, None
    try:
        if rejects_path:
            out = f"{rejects_path.rstrip('/')}/channel={channel}/batch_id={int(batch_id)}"
            rejects.drop("ingest_seq", "channel").write.mode("overwrite").parquet(out)
            n_rejects = spark.read.parquet(out).count()
        arrived = F.unix_micros("ingest_seq.arrival._time" if channel == nz.CHANNEL_C else "ingest_seq._time")
        with sinks.aside(spark, table) as repeated:
            latest = sinks.latest(spark, lines, ["id"], ["ingest_seq"], repeated).withColumn("ingest_seq", arrived)
            counts = sinks.upsert_orders(spark, table, latest, order=None, newer_by="ingest_seq" if backfill else None)
        if summary:      # only the (channel, month) partitions this batch touched
            sinks.refresh_summary_months(spark, table, summary, channel, counts["partitions"])
        if last_day:
            as_of = lines.agg(F.max("order_date").cast("string")).first()[0]
            if as_of:
                report_last_day(spark, table, last_day, source, batch_id, as_of)
    except Exception as e:
        error = e
    status = "failed" if error else "success"
    if history:
        latency = int((time.time() - t0) * 1000)
        row = (source, int(batch_id), "stream", time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime()), latency,
               counts["batch_rows"], counts["batch_lines"],
               [(channel, status, str(error or ""), counts["batch_rows"], counts["batch_lines"], latency)])
        sinks.record_run(spark.createDataFrame([row], RUN_COLUMNS), history)
    if error:
        raise error
    return {"batch_rows": counts["batch_rows"], "batch_lines": counts["batch_lines"],
            "rows_written": counts["rows_written"], "rejects": n_rejects, "status": status}


LANDED = {nz.CHANNEL_A: feeds.ORDER_A, nz.CHANNEL_B: feeds.ORDER_B,
          nz.CHANNEL_C: T.StructType(feeds.ORDER_C.fields + [T.StructField("search_status", T.StringType())])}


def order_ingest(spark: SparkSession, landing: str, table: str, checkpoint: str, summary: str | None = None,
                 history: str | None = None, trigger: dict | None = None, max_files: int | None = None,
                 channel: str = nz.CHANNEL_A, rejects: str | None = None, last_day: str | None = None,
                 on_batch: Callable[[dict], None] | None = None):
    """Start the ingest stream of one channel over ``landing`` (JSON
    lines; channel C in ``search_status=<STATUS>`` folders).

    One query per channel: a failing channel stops alone, and channels write
    to different partitions of ``table``.  Rejects are kept in ``rejects``, by default
    ``<table>_rejects``.  ``last_day`` is where T2's report of every batch goes; ``on_batch`` gets
    each batch's counts.  ``trigger`` defaults to ``availableNow`` (process what has landed, then
    stop); use ``{"processingTime": "30 minutes"}`` for the scheduled cadence.
    """
    reader = spark.readStream.schema(LANDED[channel])
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    stream = with_arrival(reader.json(landing))
    rejects = rejects or f"{table.rstrip('/')}_rejects"

    def each(df: DataFrame, batch_id: int) -> None:
        got = ingest_batch(df.sparkSession, df, batch_id, table, summary, history, channel, rejects_path=rejects, last_day=last_day)
        if on_batch:
            on_batch(got)

    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


# ---- T1: collections of a day range next to a stream ---------------------------------------

MAX_COLLECT_DAYS = 30       # fixed value: the longest window that one collection covers


def collect_window(as_of: str, days: int = 1, start: str | None = None, end: str | None = None,
                   max_days: int = MAX_COLLECT_DAYS) -> tuple[str, str]:
    """The days of a collection, both inclusive: ``start`` to ``end`` if given (an error if longer
    than ``max_days``), else the last ``days`` before ``as_of``, held within 1..``max_days``."""
    if start and end:
        length = (dt.date.fromisoformat(end) - dt.date.fromisoformat(start)).days
        if not 0 <= length <= max_days:
            raise ValueError(f"a collection covers 0 to {max_days} days, not {length}")
        return start, end
    last = dt.date.fromisoformat(as_of)
    return (last - dt.timedelta(days=max(1, min(days, max_days)))).isoformat(), as_of


def collect_days(spark: SparkSession, landing: str, table: str, start: str, end: str, run: int, channel: str = nz.CHANNEL_A,
                 summary: str | None = None, history: str | None = None, rejects: str | None = None) -> dict:
    """T1 at start-up: collect the landed records of the days ``start``..``end`` once more (the
    window from ``collect_window``), also while the channel's stream runs.

    A line that arrived later than the record (by file time) stays, so nothing is doubled or reverted; the same
    collection may be run again.  ``run`` numbers the run record."""
    raw = with_arrival(spark.read.schema(LANDED[channel]).option("basePath", landing).json(landing))
    day = F.expr(day_sql(*feeds.DAY_FIELDS[channel]))
    raw = raw.where(day.between(start, end))
    return ingest_batch(spark, raw, run, table, summary, history, channel, source=f"collect-{channel}",
                        rejects_path=rejects or f"{table.rstrip('/')}_rejects/collected", backfill=True)


# ---- T4: one run over all channels ---------------------------------------------------------

def collect_all(spark: SparkSession, landings: dict[str, str], table: str, checkpoint: str, history: str, run: int,
                summary: str | None = None, last_day: str | None = None) -> dict:
    """T4: one trigger of every channel's stream, and one run record for all of them.

    Channels run side by side and fail alone: the record has each channel's status, error,
    rows collected and saved, and time; a failed channel counts 0 rows."""
    began, queries, got = time.time(), {}, {c: [] for c in landings}
    failed: dict[str, str] = {}
    for c, landing in landings.items():
        try:
            queries[c] = order_ingest(spark, landing, table, f"{checkpoint}/{c}", summary, channel=c, last_day=last_day,
                                      on_batch=got[c].append)
        except Exception as e:      # e.g. no landing folder
            failed[c] = str(e)
    took = {}
    for c, q in queries.items():
        try:
            q.awaitTermination()
        except Exception as e:
            failed[c] = str(e)
        took[c] = int((time.time() - began) * 1000)
    channels = []
    for c in landings:
        n, saved = (0, 0) if c in failed else (sum(x[k] for x in got[c]) for k in ("batch_rows", "batch_lines"))
        channels.append((c, "failed" if c in failed else "success", failed.get(c, ""), n, saved, took.get(c, 0)))
    row = ("orders", int(run), "collect", time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime()), int((time.time() - began) * 1000),
           sum(c[3] for c in channels), sum(c[4] for c in channels), channels)
    sinks.record_run(spark.createDataFrame([row], RUN_COLUMNS), history)
    return {"channels": channels, "failed": sorted(failed)}


# ---- T2: the last day's sales over the stored orders ----------------------------------------

def last_day_sales(orders: DataFrame, as_of: str) -> DataFrame:
    """T2's exact rule: G1 over the stored lines of the day ``as_of`` and the one before, both inclusive."""
    start = (dt.date.fromisoformat(as_of) - dt.timedelta(days=1)).isoformat()
    return sales_by_channel(orders, start, as_of).withColumn("as_of", F.lit(as_of))


def report_last_day(spark: SparkSession, table: str, path: str, source: str, batch_id: int, as_of: str) -> None:
    """Append a batch's report to ``path``; a retried batch replaces its own."""
    rows = last_day_sales(sinks.read_orders(spark, table), as_of)
    sinks.replace_partitions(rows.withColumns({"source": F.lit(source), "batch_id": F.lit(int(batch_id))}), path, ["source", "batch_id"])


# ---- T2 / T3: event-time windows ---------------------------------------------------------

def event_time(df: DataFrame, col: str = "ts") -> DataFrame:
    """Cast the event time to TIMESTAMP (windows reject TIMESTAMP_NTZ)."""
    return df.withColumn(col, F.col(col).cast("timestamp"))


def hourly_sales(events: DataFrame, exact: bool = True) -> DataFrame:
    """One-day windows sliding every hour: event count, value sum and
    distinct users (exact in batch; streams use the approximate count)."""
    value = F.col("value").cast("decimal(18,2)")
    w, n, users = F.window("ts", "1 day", "1 hour").alias("w"), F.count(F.lit(1)), F.approx_count_distinct("user_id")
    if exact:
        # one row per hour and user before each is copied into its 24 windows
        events = events.groupBy(F.date_trunc("hour", "ts").alias("ts"), "user_id").agg(n.alias("n"), F.sum(value).alias("v"))
        n, value, users = F.sum("n"), F.col("v"), F.countDistinct("user_id")
    return (events.groupBy(w).agg(n.alias("events"), F.sum(value).cast("double").alias("value"), users.alias("users"))
                  .select(F.col("w.start").cast("string").alias("window_start"),
                          F.col("w.end").cast("string").alias("window_end"), "events", "value", "users"))


def daily_sales_windows(events: DataFrame) -> DataFrame:
    """Tumbling one-day windows (the streaming form of G2)."""
    return (events.groupBy(F.window("ts", "1 day").alias("w"), "event_type")
                  .agg(F.count(F.lit(1)).alias("events"),
                       F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value"))
                  .select(F.col("w.start").cast("string").alias("day"), "event_type", "events", "value"))


def event_stream(spark: SparkSession, path: str, schema: T.StructType, watermark: str = "1 day",
                 max_files: int | None = None) -> DataFrame:
    """Event stream from Parquet files with event time and watermark."""
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return event_time(r.parquet(path)).withWatermark("ts", watermark)


def dedupe_events(events: DataFrame, key: str = "event_id") -> DataFrame:
    """Drop repeats of an event id.  On a stream, state is kept only
    within the watermark (``dropDuplicatesWithinWatermark``); on a batch it
    is a plain distinct on the key."""
    if events.isStreaming:
        return events.dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def late_rows(query) -> int:
    """Rows that the stream dropped as later than its watermark, from the progress of all triggers
    (of the first stateful operator: later ones no longer see them)."""
    first = [p["stateOperators"][-1] for p in query.recentProgress if p["stateOperators"]]
    return sum(op["numRowsDroppedByWatermark"] for op in first)


def start_window_stream(stream: DataFrame, build: Callable[[DataFrame], DataFrame], sink_path: str,
                        checkpoint: str, trigger: dict | None = None):
    """Run a windowed aggregate in append mode (a window is emitted once the
    watermark passes its end) into Parquet files."""
    q = (build(stream).writeStream.outputMode("append").format("parquet")
         .option("path", sink_path).option("checkpointLocation", checkpoint)
         .trigger(**(trigger or {"availableNow": True})))
    return q.start()
