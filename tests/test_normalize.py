"""Hand-built channel-A orders: 0/1/3 items, zero item sum, fallbacks."""

from pyspark.sql import functions as F

from ledgerline.operators import normalize as nz
from ledgerline.operators import stock
from ledgerline.sources import feeds


def _orders(spark, recs):
    return spark.createDataFrame(recs, feeds.ORDER_A)


def _rec(oid, items, pay="", actual="", total="", status="N10"):
    return {"order_id": oid, "order_date": "2024-01-02T10:00:00+09:00", "order_status": status,
            "buyer_name": "b", "payment_amount": pay, "actual_payment_amount": actual, "total_price": total,
            "items": items}


def _item(no, qty, price, name="p", cv="", vc="V"):
    return {"product_no": no, "product_name": name, "quantity": qty, "product_price": price,
            "custom_variant_code": cv, "variant_code": vc}


def test_zero_one_and_three_items(spark):
    recs = [
        _rec("o0", [], pay="100"),                                        # 0 items: one empty line, qty 1
        _rec("o1", [_item("1", "2", "50", cv="CV1")], actual="99.5"),     # 1 item: payment not rounded
        _rec("o3", [_item("1", "1", "10"), _item("2", "2", "10"), _item("3", "", "10")], total="101"),
        _rec("oz", [_item("1", "1", "0"), _item("2", "1", "0"), _item("3", "1", "0")], pay="10"),  # zero sum
    ]
    out = {r.id: r for r in nz.normalize_a(_orders(spark, recs)).collect()}
    assert out["A_o0"].product_name == "" and out["A_o0"].quantity == 1 and out["A_o0"].amount == 100.0
    assert out["A_o1"].variant_code == "CV1" and out["A_o1"].quantity == 2 and out["A_o1"].amount == 99.5
    # shares 10:20:10 of 101 -> 25.25, 50.5, 25.25 -> Math.round -> 25, 51, 25 (remainder not redistributed)
    assert [out[f"A_o3_{i}"].amount for i in range(3)] == [25.0, 51.0, 25.0]
    assert out["A_o3_2"].quantity == 1                                  # missing quantity -> 1
    # zero item sum -> equal split 10/3 -> 3 each
    assert [out[f"A_oz_{i}"].amount for i in range(3)] == [3.0, 3.0, 3.0]


def test_shipped_lookup_zero_variant_total_falls_back_to_name(spark):
    inv = spark.createDataFrame([("P1", "ring", "V1"), ("P2", "ring", ""), ("P3", "cup", "V3")],
                                "product_code string, product_name string, supplier_option string")
    by_v = spark.createDataFrame([("V1", 0), ("V3", 4)], "variant_code string, day_v bigint")
    by_n = spark.createDataFrame([("ring", 7)], "product_name string, day_n bigint")
    j = stock.attach_shipped(inv, by_v, by_n)
    got = {r.product_code: (r.s, r.src) for r in j.select("product_code", stock.pick_shipped("day").alias("s"),
                                                        stock.shipped_source("day").alias("src")).collect()}
    assert got == {"P1": (7, "name"), "P2": (7, "name"), "P3": (4, "variant")}
    assert F
