"""J6 against a brute-force reading of the source rule on hand-built rows."""

from ledgerline.operators import stock


def _brute(page, items):
    out = {r["no"]: r["outgoing"] for r in page}
    for it in items:
        hit = None
        for r in sorted(page, key=lambda r: r["no"]):
            if ((r["barcode"] and r["barcode"] == it["key"]) or (r["code"] and r["code"] == it["key"])
                    or (it["name"] and r["name"] == it["name"] and it["option"] and it["option"] in r["option"])):
                hit = r["no"]
                break
        if hit is not None:
            out[hit] += it["qty"]
        else:
            for r in page:
                if it["name"] and it["name"] in r["name"]:
                    out[r["no"]] += it["qty"]
    return out


def test_sync_matches_bruteforce(spark):
    page = [
        dict(no=1, code="P1", barcode="B1", name="red ring", option="L/red", opening=10, outgoing=0, closing=10),
        dict(no=2, code="P2", barcode="", name="red ring", option="M/red", opening=5, outgoing=1, closing=4),
        dict(no=3, code="", barcode="B3", name="big red ring set", option="x", opening=0, outgoing=0, closing=0),
        dict(no=4, code="P4", barcode="B4", name="blue cup", option="", opening=3, outgoing=0, closing=3),
        dict(no=5, code="P1", barcode="", name="dup code", option="", opening=1, outgoing=0, closing=1),
    ]
    items = [
        dict(key="P1", name="x", option="", qty=2),          # code: first row with code P1 (no=1)
        dict(key="B4", name="", option="", qty=1),           # barcode
        dict(key="zz", name="red ring", option="M", qty=3),  # name + option contains
        dict(key="zz", name="red ring", option="Q", qty=4),  # no option match: every name containing it
        dict(key="", name="cup", option="", qty=5),          # contains only
        dict(key="", name="", option="", qty=9),             # nothing
    ]
    cols = "no bigint, code string, barcode string, name string, option string, opening bigint, " \
           "outgoing bigint, closing bigint"
    pdf = spark.createDataFrame([tuple(r[c] for c in ("no", "code", "barcode", "name", "option", "opening",
                                                       "outgoing", "closing")) for r in page], cols)
    idf = spark.createDataFrame([(i["key"], i["name"], i["option"], i["qty"]) for i in items],
                                "key string, name string, option string, qty bigint")
    got = {r.no: r.outgoing for r in stock.sync_outgoing(pdf, idf).collect()}
    assert got == _brute(page, items)
    closing = {r.no: r.closing for r in stock.sync_outgoing(pdf, idf).collect()}
    assert all(closing[r["no"]] == r["opening"] - got[r["no"]] for r in page)
