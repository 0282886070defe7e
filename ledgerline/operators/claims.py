"""Order pages: list rows, detail, claims view, status labels, KPIs, export
rows (P7-P10, F9, F10, G18, L5, K8 content) over raw channel-A orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.rules import js_round_sql, lit_sql, money_sql, or_sql, parse_float_sql, parse_int_sql

# ---- fixed values: status code -> stage label (17 codes) ------------------------------
STATUS_LABELS = {
    "N00": "입금대기", "N10": "결제완료", "N20": "상품준비", "N22": "배송보류", "N30": "배송중",
    "N40": "배송완료", "C00": "취소신청", "C10": "취소접수", "C34": "취소처리", "C40": "취소완료",
    "R00": "반품신청", "R10": "반품접수", "R30": "반품처리", "R40": "반품완료", "E00": "교환신청",
    "E10": "교환접수", "E40": "교환완료",
}
# List-row text: "<first item> 외 <n-1>건", in full.
MORE_ITEMS_PREFIX, MORE_ITEMS_SUFFIX = " 외 ", "건"
# Order export header (K8).
EXPORT_HEADER = ("주문번호", "일시", "주문자", "상품", "수량", "상태", "결제금액")
EXPORT_HEADER_PAYMENT = ("주문번호", "주문일시", "주문자", "상품", "수량", "상태", "결제금액", "결제방법")


def label_sql(status: str = "order_status", fallback: str | None = "?") -> str:
    """P10 as SQL: stage label of a status code.  Unknown codes keep their
    text; an empty status shows ``fallback`` (None: keep the raw value)."""
    whens = " ".join(f"WHEN {lit_sql(k)} THEN {lit_sql(v)}" for k, v in STATUS_LABELS.items())
    other = status if fallback is None else or_sql(status, default=fallback)
    return f"CASE {status} {whens} ELSE {other} END"


def status_label(status: str = "order_status") -> Column:
    """P10: stage label column (a CASE over the 17 fixed codes; no join
    needed for a fixed 17-row map)."""
    return F.expr(label_sql(status))


PAGE_AMOUNT = f"coalesce({parse_float_sql(or_sql('actual_payment_amount', 'total_amount_paid', default='0'))}, 0.0)"
STATUS_CLASS = "substring(coalesce(order_status, ''), 1, 1)"
TIME_TEXT = ("CASE WHEN order_date IS NULL OR order_date = '' THEN '-' "
             "ELSE regexp_replace(substring(order_date, 1, 16), 'T', ' ') END")


# ---- F9 / F10: filters ----------------------------------------------------------------------

def claims_view(orders: DataFrame) -> DataFrame:
    """orders whose status starts with C, R or E."""
    return orders.where(f"{STATUS_CLASS} IN ('C', 'R', 'E')")


def status_filter(orders: DataFrame, value: str | None) -> DataFrame:
    """one letter = status prefix, longer = exact status."""
    if not value:
        return orders
    if len(value) == 1:
        return orders.where(F.coalesce(F.col("order_status"), F.lit("")).startswith(value))
    return orders.where(F.col("order_status") == value)


# ---- P7 / P9: list rows --------------------------------------------------------------------------

_ITEMS = "coalesce(items, array())"
_QTY = f"aggregate({_ITEMS}, CAST(0 AS BIGINT), (s, i) -> s + {parse_int_sql(or_sql('i.quantity', default='1'))})"


def order_rows(orders: DataFrame) -> DataFrame:
    """One row per order: first item + "n more", total quantity, amount,
    refund flag, payment method."""
    first = f"coalesce(get({_ITEMS}, 0).product_name, '')"
    n = f"size({_ITEMS})"
    name = (f"CASE WHEN {n} > 1 THEN concat({first}, {lit_sql(MORE_ITEMS_PREFIX)}, CAST({n} - 1 AS STRING), "
            f"{lit_sql(MORE_ITEMS_SUFFIX)}) ELSE {first} END")
    return orders.selectExpr(
        "order_id", f"{TIME_TEXT} AS order_time", f"{or_sql('buyer_name', default='-')} AS buyer",
        f"{name} AS item_name", f"{_QTY} AS total_qty", "order_status AS status",
        f"{label_sql()} AS status_label", f"{js_round_sql(PAGE_AMOUNT)} AS amount",
        "coalesce(order_status, '') RLIKE '^[CRE]' AS is_refund",
        f"{or_sql('payment_method', default='-')} AS payment_method")


def claim_rows(orders: DataFrame) -> DataFrame:
    """Claims list row: item names joined, amount, reason (cancel
    reason, else return reason)."""
    names = or_sql(f"array_join(transform({_ITEMS}, i -> coalesce(i.product_name, '')), ', ')", default="-")
    return claims_view(orders).selectExpr(
        "order_id", f"{TIME_TEXT} AS order_time", f"{names} AS items",
        "order_status AS status", f"{label_sql()} AS status_label", f"{js_round_sql(PAGE_AMOUNT)} AS amount",
        f"{or_sql('cancel_reason', 'return_reason', default='-')} AS reason")


def order_detail(orders: DataFrame, order_id: str) -> DataFrame:
    """The items of one order; an item's status falls back to the
    order's."""
    e = orders.where(F.col("order_id") == order_id).selectExpr(
        "order_id", "order_status", "posexplode(items) AS (pos, it)")
    st = or_sql("it.order_status", "order_status")
    return e.selectExpr(
        "order_id", "pos", "coalesce(it.product_name, '') AS product_name",
        f"{or_sql('it.option_value', default='-')} AS option_value",
        f"{or_sql('it.quantity', default='1')} AS quantity",
        f"{js_round_sql('coalesce(' + parse_float_sql(or_sql('it.product_price', default='0')) + ', 0.0)')} AS price",
        f"{st} AS status", f"{label_sql(st)} AS status_label")


# ---- G18: KPIs --------------------------------------------------------------------------

def order_kpis(orders: DataFrame) -> DataFrame:
    """G18 over the (filtered) orders: counts per class, net revenue
    (neither C, R nor E), average = revenue / max(total - C - R, 1),
    refund total = C + R amounts."""
    c, a = STATUS_CLASS, money_sql(PAGE_AMOUNT)
    agg = orders.selectExpr(f"{c} AS _c", f"{a} AS _a").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.expr("coalesce(sum(CASE WHEN _c NOT IN ('C', 'R', 'E') THEN _a END), 0)").alias("_rev"),
        F.expr("coalesce(sum(CASE WHEN _c = 'C' THEN _a END), 0)").alias("_ca"),
        F.expr("coalesce(sum(CASE WHEN _c = 'R' THEN _a END), 0)").alias("_ra"),
        F.expr("count(CASE WHEN _c = 'C' THEN 1 END)").alias("cancel_count"),
        F.expr("count(CASE WHEN _c = 'R' THEN 1 END)").alias("return_count"),
        F.expr("count(CASE WHEN _c = 'E' THEN 1 END)").alias("exchange_count"))
    rev = "CAST(_rev AS DOUBLE)"
    return agg.selectExpr(
        "total_orders", f"{js_round_sql(rev)} AS revenue",
        f"CAST(CASE WHEN total_orders > 0 THEN {js_round_sql(rev + ' / greatest(total_orders - cancel_count - return_count, 1)')}"
        " ELSE 0 END AS BIGINT) AS avg_order",
        "cancel_count", "return_count", "exchange_count",
        "cancel_count + return_count + exchange_count AS claim_count",
        f"{js_round_sql('CAST(_ca AS DOUBLE)')} AS cancel_amount", f"{js_round_sql('CAST(_ra AS DOUBLE)')} AS return_amount",
        f"{js_round_sql('CAST(_ca + _ra AS DOUBLE)')} AS refund_total")


# ---- K8: export rows ------------------------------------------------------------------------

def export_rows(orders: DataFrame, separator: str = "/", payment: bool = False) -> DataFrame:
    """K8 content: one row per order; item names joined with ``separator``, label (or
    raw status), raw paid-amount text.  The second page's shape has ' / ' and the payment method (``payment``)."""
    more = [f"{or_sql('payment_method', default='')} AS payment_method"] if payment else []
    return orders.selectExpr(
        "order_id", f"{TIME_TEXT} AS order_time", "coalesce(buyer_name, '') AS buyer",
        f"array_join(transform({_ITEMS}, i -> coalesce(i.product_name, '')), {lit_sql(separator)}) AS items",
        f"CAST({_QTY} AS STRING) AS quantity", f"{label_sql('order_status', None)} AS status",
        f"{or_sql('actual_payment_amount', 'total_amount_paid', default='0')} AS amount", *more)
