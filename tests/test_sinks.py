"""Sinks write to a fresh folder and are read back."""

import datetime as dt
import glob

from pyspark.sql import functions as F

from ledgerline.sinks import tables as sinks

LINE = "id string, channel string, order_id string, order_date date, status string, product_name string, " \
       "product_no string, variant_code string, quantity bigint, amount double, customer string, ingest_seq bigint"


def _lines(spark, rows):
    return spark.createDataFrame(rows, LINE)


def test_upsert_last_write_wins_and_is_idempotent(spark, tmp_dir):
    d1, d2 = dt.date(2024, 1, 5), dt.date(2024, 2, 7)
    path = f"{tmp_dir}/orders"
    b1 = _lines(spark, [("A_1", "A", "1", d1, "N10", "p", "1", "", 1, 10.0, "c", 0),
                        ("A_2", "A", "2", d1, "N10", "q", "2", "", 2, 20.0, "c", 0)])
    sinks.upsert_orders(spark, path, b1)
    # A_1 changes status and moves to February; a duplicate inside the batch: greater seq wins
    b2 = _lines(spark, [("A_1", "A", "1", d2, "R40", "p", "1", "", 1, 10.0, "c", 1),
                        ("A_1", "A", "1", d2, "C40", "p", "1", "", 1, 10.0, "c", 0)])
    sinks.upsert_orders(spark, path, b2)
    sinks.upsert_orders(spark, path, b2)          # replay: same table
    t = spark.read.parquet(path)
    got = sorted((r.id, r.status, str(r.order_date)) for r in t.collect())
    assert got == [("A_1", "R40", "2024-02-07"), ("A_2", "N10", "2024-01-05")]


def test_upsert_drops_emptied_month(spark, tmp_dir):
    path = f"{tmp_dir}/orders"
    sinks.upsert_orders(spark, path, _lines(spark, [("A_9", "A", "9", dt.date(2023, 12, 1), "N10", "p", "1", "", 1,
                                                     1.0, "c", 0)]))
    sinks.upsert_orders(spark, path, _lines(spark, [("A_9", "A", "9", dt.date(2024, 3, 1), "N10", "p", "1", "", 1,
                                                     1.0, "c", 1)]))
    t = spark.read.parquet(path)
    assert [r.order_month for r in t.collect()] == [202403]


def test_csv_export_has_header_and_quotes(spark, tmp_dir):
    df = spark.createDataFrame([("1", 'say "hi"', 3)], "order_id string, items string, qty int")
    sinks.export_csv(df, f"{tmp_dir}/export", ["주문번호", "상품", "수량"])
    text = "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{tmp_dir}/export/part-*.csv")))
    assert text.startswith('"주문번호","상품","수량"')
    assert '"say ""hi"""' in text


def test_daily_summary_refresh_replaces_one_channel(spark, tmp_dir):
    path = f"{tmp_dir}/summary"
    a = spark.createDataFrame([("2024-01-01", "A", 1), ("2024-01-01", "B", 2)], "date string, channel string, n int")
    sinks.refresh_daily_summary(a, path)
    sinks.refresh_daily_summary(spark.createDataFrame([("2024-01-02", "A", 5)], "date string, channel string, n int"),
                                path)
    got = sorted((r.date, r.channel, r.n) for r in spark.read.parquet(path).collect())
    assert got == [("2024-01-01", "B", 2), ("2024-01-02", "A", 5)]


def test_saved_stock_latest(spark, tmp_dir):
    path = f"{tmp_dir}/saved"
    s = "code string, opening bigint, outgoing bigint"
    sinks.save_stock(spark.createDataFrame([("P1", 5, 1)], s), path, "2024-01-01")
    sinks.save_stock(spark.createDataFrame([("P1", 7, 2), ("P2", 1, 0)], s), path, "2024-01-02")
    got = sorted(tuple(r) for r in sinks.latest_saved(spark, path).collect())
    assert got == [("P1", 7, 2), ("P2", 1, 0)]


def test_run_history_round_trip(spark, tmp_dir):
    from ledgerline.streaming.ingest import RUN_COLUMNS
    path = f"{tmp_dir}/history"
    for i in range(3):
        row = ("orders-A", i, "stream", f"2024-01-0{i + 1}T00:00:00", 5, 2, 2, [("A", "success", "", 2, 2, 5)])
        sinks.append_run(spark.createDataFrame([row], RUN_COLUMNS), path)
    h = sinks.run_history(spark, path, 2).collect()
    assert [r.batch_id for r in h] == [2, 1]
    assert h[0].channels[0].saved == 2
    assert F  # keep import


def test_cost_replace_and_append(spark, tmp_dir):
    path = f"{tmp_dir}/costs"
    s = "item_code string, barcode string, item_name string, option_name string, cost_price double, " \
        "sell_price double, category string, supplier string"
    a = spark.createDataFrame([("C1", "", "n", "o", 1.0, 2.0, "c", "s")], s)
    sinks.replace_costs(a, path)
    sinks.replace_costs(a.union(a), path)
    assert spark.read.parquet(path).count() == 2          # replace: not 3
    sinks.append_costs(a, path)
    assert spark.read.parquet(path).count() == 3          # append keeps repeats


def test_rejects_are_quarantined(spark):
    from ledgerline.operators import normalize as nz
    from ledgerline.sources import feeds
    raw = spark.createDataFrame([("o1", "2024-01-01", "5"), (None, "2024-01-01", "5"), ("", "", "")],
                                "orderId string, orderedAt string, orderPrice string")
    for f in feeds.ORDER_B.fields:
        if f.name not in raw.columns:
            raw = raw.withColumn(f.name, F.lit(None).cast(f.dataType))
    good, bad = nz.split_rejects(nz.normalize_b(raw))
    assert [r.order_id for r in good.collect()] == ["o1"] and bad.count() == 2


def test_snapshot_rebuild_replaces_one_date(spark, tmp_dir):
    path = f"{tmp_dir}/snap"
    s = "date string, product_code string, shipped bigint"
    sinks.write_snapshot(spark.createDataFrame([("2024-01-01", "P1", 1), ("2024-01-02", "P1", 2)], s), path)
    sinks.write_snapshot(spark.createDataFrame([("2024-01-02", "P2", 5)], s), path)
    got = sorted((str(r.snapshot_date), r.product_code, r.shipped) for r in spark.read.parquet(path).collect())
    assert got == [("2024-01-01", "P1", 1), ("2024-01-02", "P2", 5)]


def test_upsert_replace_by_order_drops_old_single_line_id(spark, tmp_dir):
    d = dt.date(2024, 1, 5)
    path = f"{tmp_dir}/orders"
    sinks.upsert_orders(spark, path, _lines(spark, [("A_7", "A", "7", d, "N10", "p", "1", "", 1, 10.0, "c", 0)]))
    grown = _lines(spark, [("A_7_0", "A", "7", d, "N10", "p", "1", "", 1, 5.0, "c", 1),
                           ("A_7_1", "A", "7", d, "N10", "q", "2", "", 1, 5.0, "c", 1)])
    default_path = f"{tmp_dir}/orders_default"
    sinks.upsert_orders(spark, default_path, _lines(spark, [("A_7", "A", "7", d, "N10", "p", "1", "", 1, 10.0, "c", 0)]))
    sinks.upsert_orders(spark, default_path, grown)
    assert sorted(r.id for r in spark.read.parquet(default_path).collect()) == ["A_7", "A_7_0", "A_7_1"]
    sinks.upsert_orders(spark, path, grown, replace_by_order=True)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == ["A_7_0", "A_7_1"]


def test_order_export_end_to_end(spark, tmp_dir):
    from ledgerline.operators import claims
    from ledgerline.sources import feeds
    from fixture_paths import SF_SMALL
    rows = claims.export_rows(feeds.landed_a(spark, SF_SMALL))
    sinks.export_csv(rows, f"{tmp_dir}/k8", claims.EXPORT_HEADER)
    back = spark.read.option("header", True).option("escape", '"').csv(f"{tmp_dir}/k8")
    assert back.columns == list(claims.EXPORT_HEADER)
    assert back.count() == rows.count()


def _all(spark, path):
    return sorted((r.id, str(r.order_date), r.order_month) for r in sinks.read_orders(spark, path).collect())


def test_upsert_keeps_undated_lines(spark, tmp_dir):
    path, d = f"{tmp_dir}/orders", dt.date(2024, 1, 5)
    line = lambda i, day, seq: (f"A_{i}", "A", str(i), day, "N10", "p", "1", "", 1, 1.0, "c", seq)
    sinks.upsert_orders(spark, path, _lines(spark, [line(3, None, 0), line(4, d, 0)]))
    sinks.upsert_orders(spark, path, _lines(spark, [line(5, None, 1)]))             # undated rows only
    assert _all(spark, path) == [("A_3", "None", 0), ("A_4", "2024-01-05", 202401), ("A_5", "None", 0)]
    moved = _lines(spark, [line(5, d, 2), line(3, d, 2)])                            # both get a date
    for _ in range(2):                                                               # a retry changes nothing
        got = sinks.upsert_orders(spark, path, moved)
        assert _all(spark, path) == [(f"A_{i}", "2024-01-05", 202401) for i in (3, 4, 5)]
    assert got["batch_lines"] == 2 and got["rows_written"] == 3
    assert not glob.glob(f"{path}/channel=A/order_month=0/*")
    assert sinks.upsert_orders(spark, path, moved.limit(0))["rows_written"] == 0


def test_channels_keep_their_own_partitions(spark, tmp_dir):
    path, d = f"{tmp_dir}/orders", dt.date(2024, 1, 5)
    for ch in ("A", "1", ""):
        got = sinks.upsert_orders(spark, path, _lines(spark, [(f"{ch}_1", ch, "1", d, "N10", "p", "1", "", 1, 1.0, "c", 0)]))
        assert got["rows_written"] == 1
    assert sorted(r.channel for r in sinks.read_orders(spark, path).collect()) == ["1", "A", "unknown"]


def test_dated_reports_run_on_the_stored_table(spark, tmp_dir):
    from ledgerline.operators import analytics, margin, sales, stock
    path = f"{tmp_dir}/orders"
    rows = [(f"A_{m}", "A", str(m), dt.date(2001, m, 1), "N10", "p", "1", "V1", 1, 10.0, "c", 0) for m in range(1, 7)]
    sinks.upsert_orders(spark, path, _lines(spark, rows + [("A_9", "A", "9", None, "N10", "p", "1", "V1", 1, 10.0, "c", 0)]))
    o, s, e = sinks.read_orders(spark, path), "2001-02-01", "2001-04-30"
    assert [r.order_count for r in sales.sales_by_channel(o, s, e).collect()] == [3]
    assert sales.daily_sales(o, s, e).count() == 3 and sales.top_products(o, s, e, 5).count() == 1
    assert sales.range_counts(o, s, e).first().orders_count == 3
    assert margin.margin_groups(o, s, e).first().total_qty == 3
    assert margin.margin_groups(o, s, e, limit=None).count() == 1
    assert analytics.recent_channel_share(o, e).count() > 0
    assert sales.before_period(o, s, e).count() == 3
    plan = sales.in_period(spark.read.parquet(path), s, e)._jdf.queryExecution().executedPlan().toString()
    assert "order_month" in plan.split("PartitionFilters")[1][:300]
    assert stock


def test_recent_orders_and_history_have_no_hidden_limit(spark, tmp_dir):
    from ledgerline.operators import sales
    rows = [(f"A_{i}", "A", str(i), dt.date(2001, 1, 1), "N10", "p", "1", "", 1, 1.0, "c", 0) for i in range(700)]
    assert sales.recent_orders(_lines(spark, rows), 600).count() == 600


def test_snapshot_has_one_row_per_key(spark, tmp_dir):
    path = f"{tmp_dir}/snap"
    s = "date string, product_code string, option_name string, base_stock bigint"
    sinks.write_snapshot(spark.createDataFrame([("2024-01-01", "P1", "o", 9), ("2024-01-01", "P1", "o", 4), ("2024-01-01", "P1", "x", 1)], s), path)
    assert sorted((r.option_name, r.base_stock) for r in spark.read.parquet(path).collect()) == [("o", 4), ("x", 1)]


def test_session_keeps_the_launchers_master_and_needs_a_shared_folder(spark):
    import pytest
    from unittest import mock
    from ledgerline import session
    b = mock.MagicMock()
    b.appName.return_value = b.config.return_value = b
    with mock.patch.object(session, "SparkSession", mock.MagicMock(builder=b)), mock.patch.object(session, "checkpoint_dir"):
        session.build_session()
        assert not b.master.called
    far = mock.MagicMock()
    far.sparkContext.getConf().get = lambda k, d=None: {"spark.master": "spark://host:7077"}.get(k, d)
    far.conf.get = lambda k, d=None: d
    with pytest.raises(RuntimeError):
        session.checkpoint_dir(far)
