"""Registered batch forms of the streaming operators.

The same functions run on a stream (see ``ledgerline.streaming.ingest``);
here they run over the whole ``events`` table so they can be compared with
SQL.  The stream = batch equivalence itself is covered by the tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.plans.registry import plan
from ledgerline.sources.tables import read_table
from ledgerline.streaming import ingest


@plan("t02_hourly_sales", oracle="""
SELECT CAST(ws AS VARCHAR) AS window_start, CAST(ws + INTERVAL 1 DAY AS VARCHAR) AS window_end, COUNT(*) AS events,
  CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value, COUNT(DISTINCT user_id) AS users
FROM (SELECT *, date_trunc('hour', ts) - k * INTERVAL 1 HOUR AS ws FROM events, range(0, 24) r(k)) x GROUP BY ws""")
def t02(spark, sf):
    """One-day windows sliding every hour over all events."""
    return ingest.hourly_sales(ingest.event_time(read_table(spark, sf, "events")))


@plan("t02_daily_windows", oracle="""
SELECT CAST(date_trunc('day', ts) AS VARCHAR) AS day, event_type, COUNT(*) AS events,
  CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value
FROM events GROUP BY date_trunc('day', ts), event_type""")
def t02_daily(spark, sf):
    """Tumbling one-day windows per event type."""
    return ingest.daily_sales_windows(ingest.event_time(read_table(spark, sf, "events")))


@plan("t03_dedupe_replay", oracle="""
SELECT COUNT(*) AS events, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM events""")
def t03(spark, sf):
    """Events plus a replay of every 7th event one hour later; repeats
    of an event id are dropped."""
    ev = ingest.event_time(read_table(spark, sf, "events"))
    replay = ev.where(F.col("event_id") % 7 == 0).withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    d = ingest.dedupe_events(ev.unionByName(replay))
    return d.agg(F.count(F.lit(1)).alias("events"),
                 F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value"))
