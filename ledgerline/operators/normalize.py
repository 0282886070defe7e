"""Normalisation of raw channel records into order lines.

Output columns are those of the order-line table plus ``ingest_seq`` (the
order in which the upsert applies rows: greater wins).  Records without any
identifier are routed to a quarantine frame instead of receiving a generated
id that could never be joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.rules import (day_sql, js_round_sql, lit_sql, nonempty, or_sql, parse_float_sql,
                                       parse_int_sql)

# Channel labels and line-id prefixes of the three feeds.
CHANNEL_A, CHANNEL_B, CHANNEL_C = "A", "B", "C"
ID_PREFIX = {CHANNEL_A: "A_", CHANNEL_B: "B_", CHANNEL_C: "C_"}

LINE_COLUMNS = ("id", "channel", "order_id", "order_date", "status", "product_name", "product_no",
                "variant_code", "quantity", "amount", "customer")


def _text(*xs: str, default: str = "") -> str:
    return f"CAST({or_sql(*xs, default=default)} AS STRING)"


def _item_qty(i: str) -> str:
    """``parseInt(item.quantity || 1)``."""
    return parse_int_sql(or_sql(f"{i}.quantity", default="1"))


def _item_price(i: str) -> str:
    """``parseFloat(item.product_price || 0)``."""
    return parse_float_sql(or_sql(f"{i}.product_price", default="0"))


def normalize_a(orders: DataFrame, channel: str = CHANNEL_A, ingest_seq: str = "0") -> DataFrame:
    """P1 + P2: channel A order -> lines.

    <= 1 item: one line ``A_<order>`` (empty product for 0 items), quantity
    = sum of item quantities or 1, amount = payment (not rounded).
    > 1 items: one line per item ``A_<order>_<idx>``; the payment is split
    by price x quantity share (equal split when that sum is 0), each share
    rounded with ``Math.round`` (remainder not redistributed).

    ``ingest_seq`` is an SQL expression for the upsert order (greater wins).
    """
    items = "coalesce(items, array())"
    pay = parse_float_sql(or_sql("payment_amount", "actual_payment_amount", "total_price", default="0"))
    base = orders.selectExpr(
        f"{_text('order_id', 'order_no')} AS _oid",
        f"try_cast({day_sql('order_date', 'created_date')} AS DATE) AS order_date",
        f"{_text('order_status')} AS status", f"{_text('buyer_name')} AS customer",
        f"{pay} AS _pay",
        f"aggregate({items}, CAST(0.0 AS DOUBLE), (s, i) -> s + {_item_price('i')} * {_item_qty('i')}) AS _isum",
        f"aggregate({items}, CAST(0 AS BIGINT), (s, i) -> s + {_item_qty('i')}) AS _qsum",
        f"size({items}) AS _n", f"{items} AS _items", f"{ingest_seq} AS ingest_seq")
    # orders without items keep one line; every record is parsed once
    lines = base.selectExpr("*", "posexplode_outer(_items) AS (_pos, _item)")
    prefix = lit_sql(ID_PREFIX.get(channel, f"{channel}_"))
    ratio = "CASE WHEN _isum > 0 THEN ({p} * {q}) / _isum ELSE 1.0 / _n END".format(
        p=_item_price("_item"), q=_item_qty("_item"))
    return lines.selectExpr(
        f"CASE WHEN _n > 1 THEN concat({prefix}, _oid, '_', CAST(_pos AS STRING)) ELSE concat({prefix}, _oid) END AS id",
        f"{lit_sql(channel)} AS channel", "_oid AS order_id", "order_date", "status",
        f"{_text('_item.product_name')} AS product_name", f"{_text('_item.product_no')} AS product_no",
        f"{_text('_item.custom_variant_code', '_item.variant_code')} AS variant_code",
        f"CAST(CASE WHEN _n > 1 THEN {_item_qty('_item')} ELSE {or_sql('_qsum', default=1, kind='number')} END "
        "AS BIGINT) AS quantity",
        f"CASE WHEN _n > 1 THEN CAST({js_round_sql('_pay * ' + ratio)} AS DOUBLE) ELSE _pay END AS amount",
        "customer", "ingest_seq")


def normalize_b(orders: DataFrame, channel: str = CHANNEL_B, ingest_seq: str = "0") -> DataFrame:
    """Channel B record -> one line, with field fallbacks."""
    oid = _text("orderId", "shipmentBoxId")
    return orders.selectExpr(
        f"concat({lit_sql(ID_PREFIX.get(channel, f'{channel}_'))}, {oid}) AS id", f"{lit_sql(channel)} AS channel",
        f"{oid} AS order_id", f"try_cast({day_sql('orderedAt', 'createdAt')} AS DATE) AS order_date",
        f"{_text('status')} AS status", f"{_text('vendorItemName')} AS product_name",
        f"{_text('vendorItemId')} AS product_no", "'' AS variant_code",
        f"{parse_int_sql(or_sql('shippingCount', default='1'))} AS quantity",
        f"{parse_float_sql(or_sql('orderPrice', 'totalPrice', default='0'))} AS amount",
        f"{_text('receiver.name')} AS customer", f"{ingest_seq} AS ingest_seq")


def status_rank_sql(tag: str, statuses) -> str:
    """Position of a channel-C status batch in fetch order (later wins)."""
    whens = " ".join(f"WHEN {lit_sql(s)} THEN {i}" for i, s in enumerate(statuses))
    return f"CASE {tag} {whens} END"


def normalize_c(orders: DataFrame, statuses, channel: str = CHANNEL_C, ingest_seq: str | None = None) -> DataFrame:
    """Channel C record -> one line; status = search tag, else product
    status; ``ingest_seq`` = position of the batch, so the later status
    wins at the upsert.  An ``ingest_seq`` expression (arrival order) comes after the position."""
    oid = _text("productOrderId", "orderId")
    rank = f"coalesce({status_rank_sql('search_status', statuses)}, -1)"
    return orders.selectExpr(
        f"concat({lit_sql(ID_PREFIX.get(channel, f'{channel}_'))}, {oid}) AS id", f"{lit_sql(channel)} AS channel",
        f"{oid} AS order_id", f"try_cast({day_sql('orderDate', 'paymentDate')} AS DATE) AS order_date",
        f"{_text('search_status', 'productOrderStatus')} AS status", f"{_text('productName')} AS product_name",
        f"{_text('productId')} AS product_no", "'' AS variant_code",
        f"{parse_int_sql(or_sql('quantity', default='1'))} AS quantity",
        f"{parse_float_sql(or_sql('totalPaymentAmount', 'paymentAmount', default='0'))} AS amount",
        f"{_text('ordererName')} AS customer",
        (f"{rank} AS ingest_seq" if ingest_seq is None
         else f"named_struct('rank', {rank}, 'arrival', {ingest_seq}) AS ingest_seq"))


def split_rejects(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P5: lines without an order id (the source would invent one) go to a
    quarantine frame; returns (good, rejects)."""
    ok = nonempty("order_id")
    return lines.where(ok), lines.where(~ok | F.col("order_id").isNull())


def union_channels(*frames: DataFrame) -> DataFrame:
    """One feed from all channels; a missing column is null-filled."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def catalogue_stock(products: DataFrame) -> DataFrame:
    """Catalogue -> one row per variant; T/F flags to boolean, defaults
    for missing stock data (``??``: only null is missing)."""
    v = products.selectExpr("product_no", "product_name", "selling", "display", "explode_outer(variants) AS v")
    return v.selectExpr(
        "product_no", "product_name", "v.variant_code AS variant_code",
        f"{or_sql('v.option_value', default='-')} AS option_value",
        "CAST(coalesce(v.inventories.quantity, 0) AS BIGINT) AS quantity",
        "CAST(coalesce(v.inventories.safety_inventory, 0) AS BIGINT) AS safety_inventory",
        "coalesce(v.inventories.use_inventory, 'F') AS use_inventory",
        "selling = 'T' AS selling", "display = 'T' AS display")
