"""Invariants of the reports, at sf0.01."""

from pyspark.sql import functions as F

from ledgerline.plans import all_plans

from fixture_paths import SF_MID

P = all_plans()


def test_fixture_counts_match_fixtures_doc(spark):
    from ledgerline.sources import fixtures as fx
    o = fx.orders_table(spark, SF_MID)
    r = o.agg(F.count(F.lit(1)), F.countDistinct("order_id"), F.sum("quantity")).collect()[0]
    assert tuple(r) == (45832, 14743, 1160714)
    assert fx.inventory(spark, SF_MID).count() == 1875
    assert fx.costs(spark, SF_MID).count() == 2046


def test_stock_status_opening_minus_shipped_is_expected(spark):
    df = P["j02_stock_status_all"].build(spark, SF_MID)
    bad = df.where(F.col("base_stock") - F.col("shipped") != F.col("expected_stock")).count()
    assert bad == 0
    src = {r.shipped_source: r[1] for r in df.groupBy("shipped_source").count().collect()}
    assert src.get("variant") == 162 and src.get("name") == 1713


def test_snapshot_sources_for_one_day(spark):
    df = P["j01_daily_snapshot"].build(spark, SF_MID)
    src = {r.shipped_source: r[1] for r in df.groupBy("shipped_source").count().collect()}
    assert src == {"variant": 7, "name": 249, "zero": 1619}


def test_margin_branches_and_matched_plus_unmatched(spark):
    rules = {r.match_rule: r.groups for r in P["j04_match_rules"].build(spark, SF_MID).collect()}
    assert rules == {0: 20, 1: 24, 2: 11, 3: 27, 4: 6, 5: 12}
    s = P["g13_margin_summary"].build(spark, SF_MID).collect()[0]
    assert s.matched_products + s.unmatched_products == 100


def test_pivot_row_total_is_sum_of_channels(spark):
    df = P["g07_dashboard_daily"].build(spark, SF_MID)
    bad = df.where(F.abs(F.col("mall") + F.col("market") + F.col("store") - F.col("total")) > 0.005).count()
    assert bad == 0


def test_payment_split_within_bound(spark):
    df = P["p02_payment_split"].build(spark, SF_MID)
    assert df.where(~F.col("within_bound")).count() == 0


def test_status_change_later_batch_wins(spark):
    # returned lines were also fetched earlier under PAYED; the upsert keeps RETURNED
    df = P["s03_channel_c_lines"].build(spark, SF_MID)
    assert df.where(F.col("status") == "PAYED").join(
        df.where(F.col("status") == "RETURNED"), "id").count() == 0
