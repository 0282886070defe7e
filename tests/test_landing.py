"""Landed day folders, and row numbers of sheets that are split over tasks."""

import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.rules import numbered_by_blocks
from ledgerline.plans import all_plans
from ledgerline.sources import feeds, sheets

from fixture_paths import SF_SMALL

P = all_plans()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["g14_channel_summary", "g14_channel_top_products", "g15_channel_daily", "g17_channel_share",
                                  "j08_period_comparison", "j06_sync_orders"])
def test_reports_prune_the_landing(spark, name):
    if name == "j06_sync_orders":
        from ledgerline.operators import stock
        df = stock.sync_items(feeds.in_days(feeds.landed_a(spark, SF_SMALL), "2001-03-01", "2001-03-31"), "2001-03-01", "2001-03-31")
    else:
        df = P[name].build(spark, SF_SMALL)
    scans = [x for x in _plan(df).split("FileScan json")[1:]]
    assert scans and all("order_day" in x.split("PartitionFilters: [")[1].split("]")[0] for x in scans)


def _records(*days):
    return [{"order_id": str(i), **d} for i, d in enumerate(days)]


@pytest.mark.parametrize("grain", ["day", "month"])
def test_day_folders_keep_every_record(spark, tmp_dir, grain):
    path = f"{tmp_dir}/landing"
    first = _records({"order_date": "2001-01-31T10:00:00+09:00"}, {"order_date": "2001-02-01"}, {"created_date": "2001-02-28"},
                     {"order_date": "soon"}, {}, {"order_date": "", "created_date": "2001-03-01 01:02"})
    late = [{"order_id": "late", "order_date": "2001-01-31"}]
    for batch in (first, late):
        rows = feeds.parse_json(spark.createDataFrame([(json.dumps(r),) for r in batch], "j string"), "j", feeds.ORDER_A)
        feeds.land_orders(rows, path, "A", grain)
    back = feeds.read_orders_a(spark, path)
    assert sorted(r.order_id for r in back.collect()) == ["0", "1", "2", "3", "4", "5", "late"]
    day = {"day": ["2001-01-31", "2001-02-01", "2001-02-28", "2001-03-01", "none"], "month": ["2001-01-01", "2001-02-01", "2001-03-01", "none"]}
    assert sorted(x.split("=")[1] for x in os.listdir(path) if "=" in x) == day[grain]
    got = feeds.in_days(back, "2001-02-01", "2001-02-28")
    assert {"1", "2", "3", "4"} <= {r.order_id for r in got.collect()} <= {"1", "2", "3", "4", "late", "0"} - {"5"}
    assert feeds.in_days(back.drop("order_day"), "2001-02-01", "2001-02-28").count() == 7


def test_split_sheets_are_numbered_without_gaps(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/s")
    head = "품목코드,바코드,품목명,옵션명,카테고리,입고단가,출고단가"
    for f in ("b", "a"):
        with open(f"{tmp_dir}/s/{f}.csv", "w") as out:
            out.write("\n".join(["title,,,,,,", head, *[f'{"" if i % 10 == 3 else f + str(i)},x,"n, {i}",o,c,1,2' for i in range(4000)]]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = sheets.read_opening_sheet(spark, f"{tmp_dir}/s")
        assert sheets.read_cells(spark, f"{tmp_dir}/s", 3).select("file", "block").distinct().count() > 10
        rows = sorted((r.no, r.code) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert rows == list(enumerate([f"{f}{i}" for f in "ab" for i in range(4000) if i % 10 != 3], start=1))


def test_numbers_follow_blocks(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("b"), F.col("id").alias("x"))
    got = sorted((r.no, r.b, r.x) for r in numbered_by_blocks(df, ["b"], "x").collect())
    assert got == [(n, b, x) for n, (b, x) in enumerate(sorted((i % 7, i) for i in range(1000)), start=1)]
    assert numbered_by_blocks(df.limit(0), ["b"], "x").collect() == []
