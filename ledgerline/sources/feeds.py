"""Order feeds and product catalogue (S1-S4): schemas, file readers, and the
fixture feeds derived from the driver tables.

Landed feeds are JSON lines with every field optional and numbers as text,
so each reader applies an explicit schema (no inference) and the normaliser
parses numbers leniently.
"""

from __future__ import annotations

import contextlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.rules import day_sql
from ledgerline.sources import fixtures as fx
from ledgerline.sources.fixtures import _memo
from ledgerline.sources.staging import staged
from ledgerline.sources.tables import read_table, table_path

S = T.StringType()


def _fields(names: str) -> list[T.StructField]:
    return [T.StructField(n.strip(), S) for n in names.split(",")]


ITEM_A = T.StructType(_fields(
    "product_no, product_name, product_code, variant_code, custom_variant_code, option_value, quantity, "
    "product_price, order_status"))
ORDER_A = T.StructType(_fields(
    "order_id, order_no, order_date, created_date, order_status, buyer_name, billing_name, payment_amount, "
    "actual_payment_amount, total_price, total_amount_paid, payment_method, shipping_fee, cancel_reason, "
    "return_reason, refund_amount, shipping_company, tracking_number") + [
    T.StructField("payment_method_name", T.ArrayType(S)),
    T.StructField("buyer", T.StructType(_fields("name"))),
    T.StructField("receivers", T.ArrayType(T.StructType(_fields("name, phone, cellphone, address1, address2")))),
    T.StructField("items", T.ArrayType(ITEM_A)),
])
ORDER_B = T.StructType(_fields(
    "orderId, shipmentBoxId, orderedAt, createdAt, status, vendorItemId, vendorItemName, shippingCount, "
    "orderPrice, totalPrice") + [T.StructField("receiver", T.StructType(_fields("name")))])
ORDER_C = T.StructType(_fields(
    "productOrderId, orderId, orderDate, paymentDate, productOrderStatus, productName, productId, quantity, "
    "totalPaymentAmount, paymentAmount, totalProductAmount, ordererName"))
PRODUCT_A = T.StructType([
    T.StructField("product_no", T.LongType()), T.StructField("product_name", S),
    T.StructField("selling", S), T.StructField("display", S),
    T.StructField("variants", T.ArrayType(T.StructType([
        T.StructField("variant_code", S), T.StructField("option_value", S),
        T.StructField("inventories", T.StructType([
            T.StructField("quantity", T.LongType()), T.StructField("safety_inventory", T.LongType()),
            T.StructField("use_inventory", S)]))]))),
])
RUN_RECORD = T.StructType([
    T.StructField("trigger", S), T.StructField("timestamp", S), T.StructField("duration", T.LongType()),
    T.StructField("period", T.StructType([T.StructField("start", S), T.StructField("end", S),
                                          T.StructField("days", T.IntegerType())])),
    T.StructField("totalCount", T.LongType()), T.StructField("totalSaved", T.LongType()),
    T.StructField("channels", T.ArrayType(T.StructType([
        T.StructField("channel", S), T.StructField("status", S), T.StructField("error", S),
        T.StructField("count", T.LongType()), T.StructField("saved", T.LongType()),
        T.StructField("latency", T.LongType())]))),
])

# The status batches of channel C, in fetch order (a later
# batch wins when the same line appears in two).
C_STATUSES = ("PAYED", "DELIVERED", "EXCHANGED", "CANCELED", "RETURNED")


# The fields of a record's day, first filled one wins.
DAY_FIELDS = {"A": ("order_date", "created_date"), "B": ("orderedAt", "createdAt"), "C": ("orderDate", "paymentDate")}


# Landed records lie in folders of their order day, or of the first day of its month, whenever they
# arrive; records without a valid day in a folder of their own.
DAY_COLUMN, NO_DAY = "order_day", "none"


def landing_day(channel: str, grain: str = "day") -> Column:
    """The folder of a record: its day, or with ``grain`` 'month' the first day of its month."""
    day = F.expr(day_sql(*DAY_FIELDS[channel]))
    day = F.when(day == day.try_cast("date").cast("string"), day)
    return F.coalesce(F.concat(F.substring(day, 1, 7), F.lit("-01")) if grain == "month" else day, F.lit(NO_DAY))


# Landed files are compressed: as text they are several times the tables they come from.
COMPRESSION = "gzip"
OPEN_FILES = 200        # of a task that writes rows as they come


@contextlib.contextmanager
def _open_files(spark: SparkSession, n: int):
    """Let a task keep ``n`` files open instead of sorting its rows by folder."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    old = spark.conf.get(name)
    spark.conf.set(name, n)
    try:
        yield
    finally:
        spark.conf.set(name, old)


def land_orders(records: DataFrame, path: str, channel: str, grain: str = "day", partition_by: Sequence[str] = (),
                near: bool = False) -> None:
    """Append records as JSON lines to their day folders; late ones join the folder of their day.

    ``near``: records of a folder already come from few tasks (e.g. read from folders of the same
    months) and are written as they come, without a shuffle or a sort."""
    by = [*partition_by, DAY_COLUMN]
    absent = [c for c in DAY_FIELDS[channel] if c not in records.columns]       # e.g. a feed that has one of the two
    rows = records.withColumns({c: F.lit(None).cast("string") for c in absent}).withColumn(DAY_COLUMN, landing_day(channel, grain)).drop(*absent)
    if not near:
        rows = rows.hint("rebalance", *[F.col(c) for c in by])
    with _open_files(records.sparkSession, OPEN_FILES) if near else contextlib.nullcontext():
        rows.write.mode("append").option("compression", COMPRESSION).partitionBy(*by).json(path)


def in_days(raw: DataFrame, start: str, end: str) -> DataFrame:
    """Read only landing folders that may hold records of the days ``start``..``end`` (the reports'
    own filters on the days follow); landings without day folders are read whole."""
    if DAY_COLUMN not in raw.columns:
        return raw
    day = F.col(DAY_COLUMN)
    return raw.where(day.isNull() | (day == NO_DAY) | day.between(start[:7] + "-01", end))


# ---- file readers ----------------------------------------------------------------

def _landed(schema: T.StructType) -> T.StructType:
    """A feed's schema with its day folder (null where the landing has none)."""
    return T.StructType(schema.fields + [T.StructField(DAY_COLUMN, S)])


def read_orders_a(spark: SparkSession, path: str) -> DataFrame:
    """Channel A orders (nested items); one multi-file read covers all
    pages and days (U2)."""
    return spark.read.schema(_landed(ORDER_A)).json(path)


def read_orders_b(spark: SparkSession, path: str) -> DataFrame:
    """Channel B orders (flat)."""
    return spark.read.schema(_landed(ORDER_B)).json(path)


def read_orders_c(spark: SparkSession, path: str) -> DataFrame:
    """S3: channel C orders laid out as ``search_status=<STATUS>/`` folders;
    the partition column carries the status tag (U1)."""
    schema = T.StructType(ORDER_C.fields + [T.StructField("search_status", S)])
    return spark.read.schema(_landed(schema)).option("basePath", path).json(path)


def read_products_a(spark: SparkSession, path: str) -> DataFrame:
    """Product catalogue with variants and inventories."""
    return spark.read.schema(PRODUCT_A).json(path)


def land(df: DataFrame, schema: T.StructType, keep=()) -> DataFrame:
    """Round-trip records through JSON text under ``schema``: what a reader
    of the landed files sees (absent fields null, types as declared)."""
    body = [c for c in df.columns if c not in keep]
    txt = df.select(*keep, F.to_json(F.struct(*body)).alias("json"))
    return parse_json(txt, "json", schema)


def parse_json(df: DataFrame, col: str, schema: T.StructType) -> DataFrame:
    """Parse a JSON text column with ``schema`` into top-level columns."""
    others = [c for c in df.columns if c != col]
    return df.select(*others, F.from_json(col, schema).alias("_r")).select(*others, "_r.*")


# ---- fixture feeds derived from the driver tables ----------------------------------------

def _line_no(idcol="id"):
    return F.element_at(F.split(F.col(idcol), "_"), -1).cast("int")


def _line_status_tag():
    s = F.col("status")
    return (F.when(s.isin("N10", "N20"), "PAYED").when(s == "N40", "DELIVERED").when(s == "E40", "EXCHANGED")
             .when(s.isin("C40", "CANCELED"), "CANCELED").otherwise("RETURNED"))


FIXTURE_GRAIN = "month"     # the driver's orders span seven years with few records a day
_ORDER_INPUTS = ("lineitem", "orders", "part", "customer")


def _inputs(sf_dir, names=_ORDER_INPUTS):
    return [table_path(sf_dir, t) for t in names]


@_memo
def landed_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel A feed as landed JSON-lines files, read with the S1 reader."""
    def write(path: str) -> None:
        day = F.get_json_object("json", "$.order_date")
        rows = feed_a_json(spark, sf_dir).withColumn("order_date", day).withColumn("created_date", F.lit(None).cast("string"))
        rows = rows.select("json", landing_day("A", FIXTURE_GRAIN).alias(DAY_COLUMN))
        rows.hint("rebalance", DAY_COLUMN).write.option("compression", COMPRESSION).partitionBy(DAY_COLUMN).text(path)

    return staged(spark, "landing_A", _inputs(sf_dir), write=write, read=lambda p: read_orders_a(spark, p))


@_memo
def landed_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel B feed as landed JSON files, read with the S2 reader."""
    return staged(spark, "landing_B", _inputs(sf_dir), write=lambda p: land_orders(_records_b(spark, sf_dir), p, "B", FIXTURE_GRAIN, near=True),
                  read=lambda p: read_orders_b(spark, p))


@_memo
def landed_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel C feed as ``search_status=<STATUS>/`` folders, read with the
    S3 reader (the folder is the status tag)."""
    return staged(spark, "landing_C", _inputs(sf_dir),
                  write=lambda p: land_orders(_records_c(spark, sf_dir), p, "C", FIXTURE_GRAIN, ["search_status"], near=True),
                  read=lambda p: read_orders_c(spark, p))


@_memo
def landed_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue as landed JSON files, read with the S4 reader."""
    return staged(spark, "landing_products", _inputs(sf_dir, ("part",)), lambda: feed_products(spark, sf_dir),
                  read=lambda p: read_products_a(spark, p), fmt="json")


def feed_a_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel A orders as landed JSON text (column ``json``), built from the
    'mall' orders: items from the upserted lines in line order, payments
    whole numbers, some payment fields empty to exercise the fallbacks,
    orders without lines included."""
    lines = fx.orders_table(spark, sf_dir).where(F.col("channel") == "mall")
    # collected: what the item's fields are made of, in line order (a line number comes once in an order)
    line = F.struct(
        _line_no().alias("l"), "product_no", "product_name", "variant_code",
        F.when(_line_no() == 5, F.lit("")).otherwise(F.col("quantity").cast("string")).alias("quantity"),
        F.floor(F.col("amount") / F.col("quantity") + F.lit(0.5)).cast("string").alias("product_price"),
        F.col("status").alias("order_status"))

    def item(x):
        return F.struct(
            x.product_no.alias("product_no"), x.product_name.alias("product_name"),
            F.concat(F.lit("P"), x.product_no).alias("product_code"), x.variant_code.alias("variant_code"),
            F.when(x.l == 3, F.concat(F.lit("CV"), x.product_no)).otherwise(F.lit("")).alias("custom_variant_code"),
            F.lit("opt").alias("option_value"), x.quantity.alias("quantity"),
            x.product_price.alias("product_price"), x.order_status.alias("order_status"))

    items = lines.groupBy("order_id").agg(F.sort_array(F.collect_list(line)).alias("items")) \
        .select("order_id", F.transform("items", item).alias("items"))
    o = read_table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 3 == 0)
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    o = o.join(c, o.o_custkey == c.c_custkey, "left")
    key = F.col("o_orderkey")
    pay = F.floor(F.col("o_totalprice") + F.lit(0.5)).cast("bigint").cast("string")
    j = o.join(items, o.o_orderkey.cast("string") == items.order_id, "left")
    rec = F.struct(
        key.cast("string").alias("order_id"),
        F.concat(F.col("o_orderdate").cast("date").cast("string"), F.lit("T10:15:00+09:00")).alias("order_date"),
        F.coalesce(F.get(F.col("items"), 0).getField("order_status"), F.lit("N10")).alias("order_status"),
        F.col("c_name").alias("buyer_name"),
        F.when((key % 7 == 0) | (key % 11 == 0), F.lit("")).otherwise(pay).alias("payment_amount"),
        F.when(key % 11 == 0, F.lit("")).otherwise(pay).alias("actual_payment_amount"),
        pay.alias("total_price"),
        F.array(F.lit("card")).alias("payment_method_name"),
        F.coalesce(F.col("items"), F.array().cast(T.ArrayType(ITEM_A))).alias("items"))
    return j.select(F.to_json(rec).alias("json"))


def feed_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel B records as a reader sees them (staged landing files)."""
    return landed_b(spark, sf_dir)


def _records_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel B records (flat, one per line) from the 'market' lines."""
    lines = fx.orders_table(spark, sf_dir).where(F.col("channel") == "market")
    ln = _line_no()
    oid = F.concat(F.col("order_id"), F.lit("-"), ln.cast("string"))
    rec = lines.select(
        F.when(ln == 4, F.lit(None).cast("string")).otherwise(oid).alias("orderId"),
        F.concat(F.lit("box"), oid).alias("shipmentBoxId"),
        F.concat(F.col("order_date").cast("string"), F.lit("T09:00:00")).alias("orderedAt"),
        F.col("status").alias("status"), F.col("product_no").alias("vendorItemId"),
        F.col("product_name").alias("vendorItemName"),
        F.when(ln == 2, F.lit("")).otherwise(F.col("quantity").cast("string")).alias("shippingCount"),
        F.when(ln == 6, F.lit("")).otherwise(F.col("amount").cast("string")).alias("orderPrice"),
        F.col("amount").cast("string").alias("totalPrice"),
        F.struct(F.col("customer").alias("name")).alias("receiver"))
    return rec


def feed_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel C records as a reader sees them (staged landing folders)."""
    return landed_c(spark, sf_dir)


def _records_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel C records (flat, one per line) from the 'store' lines, tagged
    with their status batch; returned lines also appear, earlier, in the
    PAYED batch (a status change between collections)."""
    lines = fx.orders_table(spark, sf_dir).where(F.col("channel") == "store")
    ln = _line_no()
    base = lines.select(
        F.concat(F.col("order_id"), F.lit("-"), ln.cast("string")).alias("productOrderId"),
        F.col("order_id").alias("orderId"),
        F.concat(F.col("order_date").cast("string"), F.lit("T08:30:00")).alias("orderDate"),
        F.col("status").alias("productOrderStatus"), F.col("product_name").alias("productName"),
        F.col("product_no").alias("productId"), F.col("quantity").cast("string").alias("quantity"),
        F.when(ln == 3, F.lit("")).otherwise(F.col("amount").cast("string")).alias("totalPaymentAmount"),
        F.col("amount").cast("string").alias("paymentAmount"),
        F.col("amount").cast("string").alias("totalProductAmount"),
        F.col("customer").alias("ordererName"), _line_status_tag().alias("search_status"))
    earlier = base.where(F.col("search_status") == "RETURNED").withColumn("search_status", F.lit("PAYED")) \
        .withColumn("productOrderStatus", F.lit("N10"))
    return base.unionByName(earlier)


def feed_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue records (S4 shape) from ``part``: 1-3 variants per product;
    every 10th product has a variant without inventory data."""
    p = read_table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    n = F.lit(1) + (F.col("p_size") % 3)

    def variant(i):
        inv = F.struct(((k * 37 + i * 11) % 60).cast("bigint").alias("quantity"),
                       (F.lit(10) + k % 20).cast("bigint").alias("safety_inventory"),
                       F.when(k % 2 == 0, "T").otherwise("F").alias("use_inventory"))
        return F.struct(F.concat(F.lit("V"), k.cast("string"), F.lit("-"), i.cast("string")).alias("variant_code"),
                        F.when(i == 2, F.lit(None).cast("string"))
                         .otherwise(F.concat(F.col("p_brand"), F.lit("/"), i.cast("string"))).alias("option_value"),
                        F.when((k % 10 == 0) & (i == 1), F.lit(None).cast(
                            "struct<quantity:bigint,safety_inventory:bigint,use_inventory:string>"))
                         .otherwise(inv).alias("inventories"))

    variants = F.transform(F.sequence(F.lit(1), n), variant)
    return p.select(k.alias("product_no"), F.col("p_name").alias("product_name"),
                    F.when(k % 3 == 0, "F").otherwise("T").alias("selling"),
                    F.when(k % 5 == 0, "F").otherwise("T").alias("display"),
                    variants.alias("variants"))
