"""Sinks: the stored tables of the data model (K1-K10; K1 itself is in ``order_table``).

Tables are Parquet folders.  Replacing part of a table never reads and
overwrites the same files in one job: the new rows are first written to a
staging folder under ``spark.checkpoint.dir`` (which also cuts the lineage),
then published with dynamic partition overwrite, which swaps only the
partitions present in the staged rows; the staged copy is deleted afterwards.
Re-running a batch after a failure gives the same table.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.rules import ORDER_PARTITIONS, last_wins, order_month
from ledgerline.session import checkpoint_dir
from ledgerline.sinks import files
from ledgerline.sinks.order_table import (aside, clustered, in_parts, latest, read_orders, rebuild_index, recover_orders,  # noqa: F401
                                          upsert_orders)


@contextlib.contextmanager
def _stage(df: DataFrame, name: str, partition_by: Sequence[str] = ()):
    """``df`` written to a fresh staging folder and read back; the folder goes at the end."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/ledgerline-staging/{name}-{uuid.uuid4().hex[:12]}"
    w = (clustered(df, partition_by) if partition_by else df).write
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)     # without rows there are no files to take the schema from
    finally:
        files.delete(spark, path)


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Overwrite only the partitions present in ``df``."""
    (clustered(df, partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(*partition_by).parquet(path))


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if files.exists(spark, path) else None


# ---- K2 / K3 / K4: stock and cost tables --------------------------------------------------

def replace_stock(stock_rows: DataFrame, path: str, base_date: str) -> DataFrame:
    """K2: full replace; the last sheet row (``seq``) per (name, option)
    wins; every row is stamped with ``base_date``."""
    rows = last_wins(stock_rows, ["product_name", "option_name"], ["seq"]) \
        .withColumn("base_date", F.lit(base_date).cast("date"))
    with _stage(rows, "stock") as staged:
        staged.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path)


def replace_costs(costs: DataFrame, path: str) -> None:
    """K3: full replace of the cost list."""
    with _stage(costs, "costs") as staged:
        staged.write.mode("overwrite").parquet(path)


def append_costs(costs: DataFrame, path: str) -> None:
    """K4: append without de-duplication (the source table has no key)."""
    costs.write.mode("append").parquet(path)


# ---- K5 / K6: partition refreshes ------------------------------------------------------------

def refresh_daily_summary(summary: DataFrame, path: str) -> None:
    """K5: replace the ``channel`` partitions present in ``summary``
    (the query half is ``sales.daily_summary``)."""
    replace_partitions(summary, path, ["channel"])


def refresh_summary_months(spark: SparkSession, orders_path: str, summary_path: str, channel: str,
                           partitions: Sequence[tuple[str, int]]) -> None:
    """K5 for a stream: recompute the daily summary of one channel only for
    the (channel, month) partitions an upsert touched (the order table is read
    with partition pruning), and swap those; a month left without orders loses its summary partition."""
    from ledgerline.operators.sales import daily_summary
    months = sorted({m for c, m in partitions if c == channel})
    if not months:
        return
    orders = read_orders(spark, orders_path).where(in_parts([(channel, m) for m in months]))
    summ = daily_summary(orders, channel).withColumn("order_month", order_month("date"))
    with _stage(summ, "summary", ORDER_PARTITIONS) as staged:
        kept = {r[0] for r in staged.select("order_month").distinct().collect()}          # one per month
        if kept:
            replace_partitions(staged, summary_path, ORDER_PARTITIONS)
    for m in sorted(set(months) - kept):
        files.delete(spark, f"{summary_path}/channel={channel}/order_month={m}")


SNAPSHOT_KEY = ("date", "product_code", "option_name")


def write_snapshot(snapshot: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """K6: replace the snapshot of the dates present (delete + rebuild).

    One row per (date, product code, option): the greatest ``order`` tuple
    wins; by default the lowest stock, as the source writes rows by falling stock."""
    key = [c for c in SNAPSHOT_KEY if c in snapshot.columns]
    rows = snapshot
    if not order and "base_stock" in snapshot.columns:
        rows, order = snapshot.withColumn("_low", -F.col("base_stock")), ("_low",)
    rows = last_wins(rows, key, list(order)).select(*snapshot.columns)
    replace_partitions(rows.withColumnRenamed("date", "snapshot_date"), path, ["snapshot_date"])


# ---- K7: run history ---------------------------------------------------------------------------

def append_run(record: DataFrame, path: str) -> None:
    """K7: append run records; per-channel metrics kept as JSON text."""
    record.select(*[c for c in record.columns if c != "channels"],
                  F.to_json("channels").alias("channels_json")).write.mode("append").parquet(path)


def record_run(record: DataFrame, path: str) -> None:
    """K7/T4: one run record per (source, batch id); a retried batch replaces its record."""
    replace_partitions(record.select(*[c for c in record.columns if c != "channels"], F.to_json("channels").alias("channels_json")),
             path, ["source", "batch_id"])


def run_history(spark: SparkSession, path: str, limit: int | None = 50) -> DataFrame:
    """Newest runs first (ties by batch id), at most ``limit``, or all with None; metrics parsed back."""
    from ledgerline.sources.feeds import RUN_RECORD
    chan = [f for f in RUN_RECORD.fields if f.name == "channels"][0].dataType
    h = spark.read.parquet(path)
    ties = [F.col("batch_id").desc()] if "batch_id" in h.columns else []
    h = h.orderBy(F.col("timestamp").desc(), *ties)
    return ((h if limit is None else h.limit(limit))
             .withColumn("channels", F.from_json("channels_json", chan)).drop("channels_json"))


# ---- K8 / K9: CSV exports ------------------------------------------------------------------------

BOM = "\ufeff"


def export_csv(rows: DataFrame, path: str, header: Sequence[str] | None = None, bom: bool = False) -> None:
    """K8/K9: CSV with a header row, every field quoted (quotes doubled),
    UTF-8.  One file per partition: large exports are written in parallel,
    not funnelled through one task.

    ``bom``: every file begins with a byte-order mark, as spreadsheet programs expect.  The
    CSV writer has no such option, so the lines are written as text, with mark and header in
    front of a partition's first line (null is an empty field; without rows there is no file)."""
    names = list(header or rows.columns)
    if bom:
        quoted = lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
        line = F.concat_ws(",", *[quoted(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in rows.columns])
        top = BOM + ",".join('"' + n.replace('"', '""') + '"' for n in names) + "\n"
        first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0          # the place in the partition
        rows.select(F.when(first, F.concat(F.lit(top), line)).otherwise(line).alias("line")).write.mode("overwrite").text(path)
        return
    out = rows.toDF(*names)
    (out.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"')
        .option("encoding", "UTF-8").csv(path))


# ---- K10: saved stock --------------------------------------------------------------------------------

def save_stock(saved: DataFrame, path: str, as_of: str) -> None:
    """Saved (code, opening, outgoing) for a day; each day is its own
    partition, so re-saving a day replaces only that day."""
    replace_partitions(saved.withColumn("as_of", F.lit(as_of)), path, ["as_of"])


def latest_saved(spark: SparkSession, path: str) -> DataFrame:
    """K10 "latest": the rows of the greatest ``as_of`` partition."""
    s = spark.read.parquet(path)
    last = s.agg(F.max("as_of").alias("as_of"))
    return s.join(F.broadcast(last), "as_of").drop("as_of")   # one-row side
