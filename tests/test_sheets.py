from ledgerline.operators import stock
from ledgerline.sources import sheets


def test_opening_sheet_reads_all_columns(spark, tmp_path):
    names = list(stock.OPENING_SHEET_HEADERS.values())
    row = ["A1", "8800", "ring", "red", "rings", "1200", "3400"]
    (tmp_path / "a.csv").write_text("\n".join(["list", ",".join([*map(str, range(30)), *names, "more"]),
                                               ",".join(["x"] * 30 + row + ["y"])]) + "\n")
    (tmp_path / "b.csv").write_text("\n".join([",".join(names[::-1]), ",".join(row[::-1])]) + "\n")
    got = sheets.read_opening_sheet(spark, str(tmp_path)).select("code", "barcode", "name", "option", "category", "cost", "price").collect()
    assert [tuple(r) for r in got] == [("A1", "8800", "ring", "red", "rings", 1200.0, 3400.0)] * 2
