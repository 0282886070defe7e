"""Uploaded sheets and cost lists as files.

Sheets are read as text cells with the file they come from and their place in
it; several files are read at once.  A row's place is the start of its block of
the file plus its number in the block, so it keeps the file's order when a
large file is split over many tasks, without sorting the file in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.rules import numbered_by_blocks
from ledgerline.operators import margin, stock


PLACE = ("file", "block", "pos")


def read_cells(spark: SparkSession, path, width: int) -> DataFrame:
    """(file, block, pos, c0 .. c<width-1>): every row of the CSV files, no header taken.
    ``block`` is where the row's split of the file starts."""
    cells = [f"c{i}" for i in range(width)]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in cells])
    raw = spark.read.schema(schema).option("escape", '"').option("maxColumns", max(20480, width + 1)).csv(path).select(
        *cells, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"))
    # a block is read by one task, so its ids are consecutive
    first = raw.groupBy("file", "_block").agg(F.min("_id").alias("_first"))
    return raw.join(first, ["file", "_block"]).select(
        "file", F.col("_block").alias("block"), (F.col("_block") + F.col("_id") - F.col("_first")).alias("pos"), *cells)


def header_width(spark: SparkSession, path) -> int:
    """The largest number of cells a header row of the files may have (commas in quotes count)."""
    line = F.col("value")
    heads = spark.read.text(path).where(line.contains(stock.HEADER_MARKER))
    return heads.agg(F.coalesce(F.max(F.length(line) - F.length(F.replace(line, F.lit(","), F.lit("")))), F.lit(0))).first()[0] + 1


def named_cells(raw: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows after each file's header row, cells under the header's names
    (a name the header lacks gives nulls)."""
    cells = [c for c in raw.columns if c not in PLACE]
    row = F.array(*cells)
    marked = F.exists(row, lambda x: F.coalesce(x.contains(stock.HEADER_MARKER), F.lit(False)))
    heads = raw.where(marked).groupBy("file").agg(F.min(F.struct("pos", row.alias("names"))).alias("h"))
    at = lambda n: F.get(row, F.expr(f"nullif(array_position(transform(h.names, x -> trim(x)), '{n}'), 0) - 1").cast("int"))
    return raw.join(heads, "file").where(F.col("pos") > F.col("h.pos")).select(*PLACE, *[at(n).alias(n) for n in names])


def read_stock_sheet(spark: SparkSession, path) -> DataFrame:
    """Stock sheets with a header in the first row -> stock rows."""
    return stock.parse_stock_sheet(spark.read.option("header", True).option("escape", '"').csv(path))


def read_cost_sheet(spark: SparkSession, path) -> DataFrame:
    """Positional cost sheets, the header found in each file -> cost list."""
    raw = read_cells(spark, path, 10)
    cells = [c for c in raw.columns if c not in PLACE]
    return margin.parse_cost_sheet(stock.locate_header(raw, cells, "pos", "file"), cells).drop("pos", "block")


def read_cost_json(spark: SparkSession, path) -> DataFrame:
    """Cost lists as JSON lines; write with ``sinks.replace_costs`` or ``append_costs``."""
    return margin.cost_items(spark.read.schema(margin.COST_JSON_SCHEMA).json(path))


def read_opening_sheet(spark: SparkSession, path) -> DataFrame:
    """Opening-stock sheets, columns by the names of each file's header row -> items.

    ``no`` numbers the items 1..n by file and place, without gaps, however the files are split.  A file
    without a header row has no named columns and gives no items."""
    names = list(stock.OPENING_SHEET_HEADERS.values())
    rows = named_cells(read_cells(spark, path, header_width(spark, path)), names)
    return numbered_by_blocks(stock.parse_opening_sheet(rows, keep=PLACE), ["file", "block"], "pos").drop(*PLACE)
