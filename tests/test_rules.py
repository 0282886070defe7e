"""Hand-built rows for the rules of the data model."""

from pyspark.sql import functions as F

from ledgerline.functions import rules as R


def _one(spark, expr_col, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr_col).collect()]


def test_effective_sale_is_case_insensitive(spark):
    got = _one(spark, R.effective_sale("s"), [("N40",), ("C40",), ("refund",), ("RETURNED",), ("E40",), ("cancel",)],
               "s string")
    assert got == [True, False, False, False, True, False]


def test_strict_rule_is_case_sensitive(spark):
    got = _one(spark, R.effective_sale_strict("s"), [("refund",), ("R40",), ("",)], "s string")
    assert got == [True, False, True]


def test_js_round_differs_from_sql_round_on_negative_halves(spark):
    got = _one(spark, R.js_round("x"), [(-2.5,), (2.5,), (-0.4,), (1.49,)], "x double")
    assert got == [-2, 3, 0, 1]
    sql = _one(spark, F.round("x", 0), [(-2.5,)], "x double")
    assert sql == [-3.0]


def test_js_rate_one_decimal(spark):
    got = _one(spark, R.js_rate("a", "b"), [(1.0, 3.0), (-1.0, 8.0), (2.0, 3.0)], "a double, b double")
    assert got == [33.3, -12.5, 66.7]


def test_lenient_numbers(spark):
    got = _one(spark, R.lenient_double("t"), [("12abc",), ("abc",), (" 3.5kg",), ("",), (None,), ("-1e2x",)],
               "t string")
    assert got == [12.0, None, 3.5, None, None, -100.0]
    got = _one(spark, R.lenient_int("t"), [("7 pcs",), ("x7",), ("0",)], "t string")
    assert got == [7, None, 0]


def test_falsy_coalesce_kinds(spark):
    rows = [("0", 0, None), ("", 5, "b"), (None, None, None)]
    schema = "a string, n bigint, b string"
    assert _one(spark, R.falsy_coalesce("a", "b", default="z"), rows, schema) == ["0", "b", "z"]
    assert _one(spark, R.falsy_coalesce("n", default=1, kind="number"), rows, schema) == [1, 5, 1]
    assert _one(spark, R.falsy_coalesce("a", "b", default="z", kind="cell"), rows, schema) == ["z", "b", "z"]


def test_sql_text_helpers_match_column_helpers(spark):
    df = spark.createDataFrame([("12abc",), ("",), (None,), ("0.00",)], "t string")
    a = [r[0] for r in df.select(R.lenient_double(R.falsy_coalesce("t", default="0", kind="cell"))).collect()]
    b = [r[0] for r in df.selectExpr(R.parse_float_sql(R.or_sql("t", default="0", kind="cell"))).collect()]
    assert a == b == [12.0, 0.0, 0.0, 0.0]


def test_last_wins_keeps_greatest_order_and_is_deterministic(spark):
    df = spark.createDataFrame([("k", 1, "old"), ("k", 3, "new"), ("k", 2, "mid"), ("j", 1, "x"), ("j", 1, "y")],
                               "id string, seq int, v string")
    out = {r.id: r.v for r in R.last_wins(df, ["id"], ["seq"]).collect()}
    assert out == {"k": "new", "j": "y"}


def test_numbered_is_dense_in_order(spark):
    df = spark.range(0, 1000).selectExpr("id * 7 % 1009 AS pos").repartition(5)
    out = sorted((r.pos, r.no) for r in R.numbered(df, "pos", "no").collect())
    assert [no for _, no in out] == list(range(1, 1001))
