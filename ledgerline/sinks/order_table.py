"""K1: the stored order table, replaced line by line through an id index and committed by one rename.

Layout of the table's folder (names with ``_`` are not part of a plain read):

``channel=C/order_month=M/``  the rows;
``_index/<n>-<buckets>/bucket=B/``  (key, channel, order_month): where lines and orders may be stored, by
    hash of the key.  Entries are only added, and before the rows are: the index may name a partition that no
    longer holds the key (which costs a needless rewrite), never the other way round;
``_staged/<batch>/``  what a batch has written and not yet published;
``_commits/<batch>.json``  a committed batch whose folders are not all in place yet.

A batch reads the index buckets of its own keys and the partitions that hold or get its lines, and
nothing else.  New versions of these partitions are written aside once; the batch is committed when its
manifest is renamed into ``_commits``.  Then each folder replaces the old one by a rename.  A batch stopped before the commit has
changed nothing; one stopped after it is finished by the next ``upsert_orders`` (or ``recover_orders``), and
``read_orders`` already reads its new folders where they are.  One driver writes a table at a time (its streams take turns).
"""

from __future__ import annotations

import contextlib
import threading
import uuid
from collections import defaultdict
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions.rules import ORDER_PARTITIONS, last_wins, order_month
from ledgerline.sinks import files

NO_CHANNEL = "unknown"
COMPRESSION = "zstd"            # of the rows, the index and what a batch writes aside: each batch writes its partitions again
ENTRIES_PER_LINE = 2            # at most: a line's and its order's
INDEX_ROWS = 1_000_000          # entries a bucket should hold; more buckets when the index is built again
INDEX_FILES = 32                # files a bucket may hold before the index is built again
REPEATED_KEYS = 500_000         # repeated keys of a batch up to which only their rows are shuffled
SLICE_BYTES = 32 << 20          # of a partition's rows, about, that one task rewrites

_LOCKS: dict[str, threading.RLock] = defaultdict(threading.RLock)
Part = tuple[str, int]


def clustered(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Rows of a partition together, so that a task writes few folders; Spark
    splits partitions that are large and merges small ones."""
    return df.hint("rebalance", *[F.col(c) for c in partition_by])


def _typed(df: DataFrame) -> DataFrame:
    return df.withColumns({"channel": F.col("channel").cast("string"), "order_month": F.col("order_month").cast("int")})


def _keyed(batch: DataFrame) -> DataFrame:
    """Partition columns that are never null: undated lines have a month of their own."""
    channel = F.when(F.col("channel") != "", F.col("channel")).otherwise(NO_CHANNEL)
    return batch.withColumns({"channel": channel, "order_month": order_month()})


def in_parts(parts: Iterable[Part]) -> Column:
    """Filter on (channel, month) partitions, as pruned by the scan."""
    by: dict[str, list[int]] = {}
    for c, m in sorted(parts):
        by.setdefault(c, []).append(m)
    cond = F.lit(False)
    for c, months in by.items():
        cond = cond | ((F.col("channel") == c) & F.col("order_month").isin(months))
    return cond


def _parts(spark: SparkSession, path: str) -> dict[Part, str]:
    """(channel, month) -> relative folder, from the folder names."""
    return {(c, int(m)): d for (c, m), d in files.partitions(spark, path, 2).items()}


# ---- commit ----------------------------------------------------------------------------------------

def _pending(spark: SparkSession, path: str) -> list[dict]:
    return [files.read_json(spark, f"{path}/_commits/{n}") for n in files.names(spark, f"{path}/_commits") if n.endswith(".json")]


def _finish(spark: SparkSession, path: str, commit: dict) -> None:
    """Put a committed batch's folders in place; what is in place already is left."""
    new = f"{path}/_staged/{commit['batch']}/new"
    left = set(files.partitions(spark, new, 2).values())
    for d in commit["replaced"]:
        if d in left:
            files.delete(spark, f"{path}/{d}")
            files.move(spark, f"{new}/{d}", f"{path}/{d}")
    for d in commit["removed"]:
        files.delete(spark, f"{path}/{d}")
    files.delete(spark, f"{path}/_commits/{commit['batch']}.json")
    files.delete(spark, f"{path}/_staged/{commit['batch']}")


def recover_orders(spark: SparkSession, path: str) -> int:
    """Finish committed batches, drop what uncommitted ones left; the number of batches finished."""
    with _LOCKS[path]:
        pending = _pending(spark, path)
        for commit in pending:
            _finish(spark, path, commit)
        for left in ("_staged", "_commits"):
            files.delete(spark, f"{path}/{left}")
        return len(pending)


def read_orders(spark: SparkSession, path: str) -> DataFrame:
    """The stored order table, partition columns in their declared types; committed
    batches count whether or not their folders are in place."""
    new, gone = [], set()
    for commit in _pending(spark, path):
        staged = f"{path}/_staged/{commit['batch']}/new"
        moved = set(files.partitions(spark, staged, 2).values())
        gone |= {d for d in commit["replaced"] if d in moved} | set(commit["removed"])
        new += [staged] * bool(moved)
    if not gone:
        return _typed(spark.read.parquet(path))
    live = _parts(spark, path)
    frames = [_typed(spark.read.parquet(p)) for p in new]
    if set(live.values()) - gone:
        frames.insert(0, _typed(spark.read.parquet(path)).where(~in_parts(k for k, d in live.items() if d in gone)))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


# ---- index -----------------------------------------------------------------------------------------

def _line_key(id_col: Column) -> Column:
    return F.concat(F.lit("i:"), id_col)


def _order_key(channel: Column, order: Column) -> Column:
    return F.concat(F.lit("o:"), channel, F.lit(":"), order)


def _entries(lines: DataFrame, repeats: bool = False) -> DataFrame:
    """Index entries of lines: one per line, one per order and partition (with ``repeats``, per line of the order)."""
    parts = list(ORDER_PARTITIONS)
    by_line = lines.select(_line_key(F.col("id")).alias("key"), *parts)
    orders = lines.where("order_id IS NOT NULL").select(_order_key(F.col("channel"), F.col("order_id")).alias("key"), *parts)
    return by_line.unionByName(orders if repeats else orders.distinct()).where("key IS NOT NULL")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")


def _generation(spark: SparkSession, path: str) -> tuple[str, int] | None:
    """(folder, buckets) of the newest complete index."""
    done = [n for n in files.names(spark, f"{path}/_index") if files.exists(spark, f"{path}/_index/{n}/_DONE")]
    newest = max(done, key=lambda n: int(n.split("-")[0]), default=None)
    return newest and (f"{path}/_index/{newest}", int(newest.split("-")[1]))


def _write_entries(entries: DataFrame, to: str, buckets: int) -> None:
    rows = entries.withColumn("bucket", _bucket(buckets))
    clustered(rows, ["bucket"]).write.option("compression", COMPRESSION).partitionBy("bucket").parquet(to)


def rebuild_index(spark: SparkSession, path: str, index_rows: int = INDEX_ROWS) -> None:
    """Build the index from the stored lines, with as many buckets as they need now."""
    with _LOCKS[path]:
        recover_orders(spark, path)
        old = files.names(spark, f"{path}/_index")
        n = max([int(x.split("-")[0]) for x in old], default=-1) + 1
        stored = read_orders(spark, path)
        buckets = 1 << (max(stored.count(), 1) * ENTRIES_PER_LINE // index_rows).bit_length()        # counted from file footers
        to = f"{path}/_index/{n}-{buckets}"
        _write_entries(_entries(stored), to, buckets)
        files.write_text(spark, f"{to}/_DONE", "")
        for x in old:
            files.delete(spark, f"{path}/_index/{x}")


def _index_due(spark: SparkSession, path: str) -> bool:
    """Whether there is no index, or many batches have added files to it."""
    now = _generation(spark, path)
    return now is None or files.file_count(spark, now[0]) > INDEX_FILES * (1 + now[1])


def lookup(spark: SparkSession, path: str, keys: DataFrame, repeats: DataFrame | None = None) -> DataFrame:
    """``keys`` (key, ...) with the partitions (was_channel, was_month) that may
    hold them, null where none does.  Reads the index buckets of the keys only.
    ``repeats``: the same keys, where they come cheaper if some are repeated."""
    folder, buckets = _generation(spark, path)
    mine = [r[0] for r in (keys if repeats is None else repeats).select(_bucket(buckets)).distinct().collect()]     # at most ``buckets``
    index = spark.read.schema("key string, channel string, order_month int, bucket int").parquet(folder).where(F.col("bucket").isin(mine))
    was = index.select(F.col("key"), F.col("channel").alias("was_channel"), F.col("order_month").alias("was_month"))
    return keys.join(was, "key", "left")


def _add_entries(spark: SparkSession, path: str, entries: DataFrame, work: str) -> None:
    """Add entries to the index: written aside, then moved into the buckets one file at a time."""
    folder, buckets = _generation(spark, path)
    _write_entries(entries, f"{work}/index", buckets)
    for d in files.partitions(spark, f"{work}/index", 1).values():
        for n in files.names(spark, f"{work}/index/{d}"):
            if not n.startswith((".", "_")):
                files.move(spark, f"{work}/index/{d}/{n}", f"{folder}/{d}/{n}")


# ---- upsert ----------------------------------------------------------------------------------------

@contextlib.contextmanager
def aside(spark: SparkSession, path: str):
    """A folder next to a table for what one batch writes and reads again."""
    folder = f"{path.rstrip('/')}_aside-{uuid.uuid4().hex[:12]}"
    try:
        yield folder
    finally:
        files.delete(spark, folder)


def latest(spark: SparkSession, rows: DataFrame, keys: Sequence[str], order: Sequence[str], aside: str,
           counted: Observation | None = None) -> DataFrame:
    """``rules.last_wins`` of rows whose keys seldom repeat.

    Hashes of the keys are grouped first, which shuffles a number a row; those that come more than once are
    written to the folder ``aside`` (the caller removes it), and only their rows go through the window.  With more than
    ``REPEATED_KEYS`` of them, all rows do.  ``counted`` counts the rows as they are read for the hashes."""
    rows = rows.select(*keys, *order, *[c for c in rows.columns if c not in keys and c not in order])
    key = F.xxhash64(*keys)
    seen = rows if counted is None else _counted(rows, counted)
    seen.groupBy(key.alias("_key")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_key").write.option("compression", COMPRESSION).parquet(aside)
    repeated = spark.read.schema("_key bigint").parquet(aside)
    n = repeated.count()            # from file footers
    if n == 0:
        return rows
    if n > REPEATED_KEYS:
        return last_wins(rows, keys, order)
    keyed, repeated = rows.withColumn("_key", key), F.broadcast(repeated)
    once = keyed.join(repeated, "_key", "left_anti").drop("_key")
    return once.unionByName(last_wins(keyed.join(repeated, "_key", "left_semi").drop("_key"), keys, order))


def upsert_orders(spark: SparkSession, path: str, batch: DataFrame, order: Sequence[str] | None = ("ingest_seq",),
                  replace_by_order: bool = False, index_rows: int = INDEX_ROWS, newer_by: str | None = None) -> dict:
    """K1: replace order lines by ``id``, last write wins.

    A batch row always replaces the stored row with the same id; inside the
    batch the greatest ``order`` tuple wins (None: the caller holds that the batch has
    every id once, and it is not shuffled for it).  The table is partitioned by
    (channel, ``order_month``); lines without a date are kept in month 0.  Only partitions
    that receive a batch row, or that the index names for a batch id (a line
    whose date moved), are read and rewritten, and one left without rows is removed.
    Retrying a batch, also one stopped at any point, gives the same table.

    ``replace_by_order``: the source keeps the old single-line id when an
    order grows from one item to several; with this option every stored line
    of a (channel, order) present in the batch is replaced instead.

    ``newer_by``: a column by which a batch row must be greater than the stored row with its id to
    replace it (a collection of older records next to a running stream must not revert lines).

    Returns the batch row count, the surviving batch lines, the rows written
    (all rows of the touched partitions) and the touched (channel, month) pairs.
    """
    path = path.rstrip("/")
    with _LOCKS[path], aside(spark, path) as repeated:
        recover_orders(spark, path)
        name = uuid.uuid4().hex
        work, parts = f"{path}/_staged/{name}", list(ORDER_PARTITIONS)
        live = _parts(spark, path)
        seen, lines, written = Observation(), Observation(), Observation()
        rows = _keyed(batch)
        rows = _counted(rows, seen) if order is None else latest(spark, rows, ["id"], list(order), repeated, seen)
        if not live:
            _counted(_counted(clustered(rows, parts), lines), written).write.option("compression", COMPRESSION).partitionBy(*parts).parquet(f"{work}/new")
            touched = set(_parts(spark, f"{work}/new"))
        else:
            if _index_due(spark, path):
                rebuild_index(spark, path, index_rows)
            _counted(rows, lines).write.option("compression", COMPRESSION).parquet(f"{work}/batch")
            # without rows there are no files to take the schema from
            merged = spark.read.schema(rows.schema).parquet(f"{work}/batch")
            touched = _merge(spark, path, work, merged, replace_by_order, written, newer_by)
        new = _parts(spark, f"{work}/new")
        removed = sorted(live[p] for p in touched if p in live and p not in new)
        if new or removed:
            commit = {"batch": name, "replaced": sorted(new.values()), "removed": removed}
            files.write_json(spark, f"{path}/_commits/{name}.json", commit)
            _finish(spark, path, commit)
        files.delete(spark, work)
        # an empty batch's plan may not hold the counters
        return {"batch_rows": seen.get["n"] if touched else 0, "batch_lines": lines.get["n"] if touched else 0,
                "rows_written": written.get["n"] if new else 0, "partitions": sorted(touched)}


def _counted(df: DataFrame, by: Observation) -> DataFrame:
    """Rows counted by the job that writes them.  (Tasks run again after the loss of an executor may count
    twice before a shuffle; counts in the writing tasks are exact.)"""
    return df.observe(by, F.count(F.lit(1)).alias("n"))


def _merge(spark: SparkSession, path: str, work: str, merged: DataFrame, replace_by_order: bool, written: Observation,
           newer_by: str | None = None) -> set[Part]:
    """Write the new versions of all partitions that hold or get lines of the batch to
    ``work/new``, and the index entries that are missing; the partitions."""
    parts = list(ORDER_PARTITIONS)
    lookup(spark, path, _entries(merged), _entries(merged, repeats=True)).write.option("compression", COMPRESSION).parquet(f"{work}/keys")
    keys = spark.read.parquet(f"{work}/keys")
    here = (F.col("channel") == F.col("was_channel")) & (F.col("order_month") == F.col("was_month"))
    found = keys.where("was_month IS NOT NULL")
    missing = found.groupBy("key", *parts).agg(F.coalesce(F.bool_or(here), F.lit(False)).alias("known")).where("NOT known").select("key", *parts)
    missing = keys.where("was_month IS NULL").select("key", *parts).unionByName(missing)        # keys that nothing was found for come once
    _add_entries(spark, path, missing, work)
    kinds = found if replace_by_order else found.where(F.col("key").startswith("i:"))
    gets = {(r[0], r[1]): r[2] for r in merged.groupBy(*parts).agg(F.count(F.lit(1))).collect()}          # one per channel and month
    touched = set(gets) | {(r[0], r[1]) for r in kinds.select("was_channel", "was_month").distinct().collect()}
    if not touched:
        return touched
    live = _parts(spark, path)
    stored = read_orders(spark, path).where(in_parts(touched))
    if not touched & set(live):
        out = clustered(merged, parts)
    elif newer_by:
        was = stored.select("id", F.col(newer_by).alias("_was"))
        merged = merged.join(was, "id", "left").where(F.col("_was").isNull() | (F.col(newer_by) > F.col("_was"))).select(*merged.columns)
        key = ["channel", "order_id"] if replace_by_order else ["id"]
        keep = stored.join(merged.select(*key).distinct(), key, "left_anti")
        out = clustered(keep.unionByName(merged, allowMissingColumns=True), parts)
    else:
        held = max(files.total_size(spark, f"{path}/{live[p]}") for p in touched & set(live))
        got = files.total_size(spark, f"{work}/batch") * max(gets.values(), default=0) // max(sum(gets.values()), 1)
        elsewhere = found.where(~here)
        if replace_by_order:
            left = elsewhere.where(F.col("key").startswith("o:")).select(
                F.expr("substring(key, length(channel) + 4)").alias("order_id"), F.col("was_channel").alias("channel"), F.col("was_month").alias("order_month"))
        else:
            left = elsewhere.where(F.col("key").startswith("i:")).select(
                F.expr("substring(key, 3)").alias("id"), F.col("was_channel").alias("channel"), F.col("was_month").alias("order_month"))
        out = _replaced(stored, merged, left, "order_id" if replace_by_order else "id", 1 + (held + got) // SLICE_BYTES)
    _counted(out, written).write.option("compression", COMPRESSION).partitionBy(*parts).parquet(f"{work}/new")
    return touched


def _replaced(stored: DataFrame, merged: DataFrame, left: DataFrame, key: str, slices: int) -> DataFrame:
    """The stored rows that a batch does not replace, and the batch's, shuffled once, each partition in ``slices``.

    A stored row is replaced if its partition gets a row of the batch with its ``key``, or is named with it in
    ``left`` (key, channel, order_month: where the batch's keys were stored elsewhere)."""
    parts = list(ORDER_PARTITIONS)
    rows = stored.withColumn("_by", F.lit(0)).unionByName(merged.withColumn("_by", F.lit(1)), allowMissingColumns=True)
    rows = rows.unionByName(left.withColumn("_by", F.lit(2)), allowMissingColumns=True)
    rows = rows.withColumn("_slice", F.pmod(F.xxhash64(key), F.lit(slices)).cast("int")).repartition(*parts, "_slice")
    most = F.max("_by").over(Window.partitionBy(*parts, "_slice", key))
    keep = (F.col("_by") == 1) | ((F.col("_by") == 0) & (F.col(key).isNull() | (F.col("_most") == 0)))
    return rows.withColumn("_most", most).where(keep).drop("_by", "_slice", "_most")
