"""Streaming = batch: T1 over split landing files, T2 windows, T3 repeats."""

import datetime as dt
import json
import os

from pyspark.sql import functions as F

from ledgerline.functions.rules import last_wins
from ledgerline.operators import normalize as nz
from ledgerline.sources import feeds
from ledgerline.streaming import ingest

from fixture_paths import SF_SMALL


def _write_lines(path, records):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        for r in records:
            f.write(json.dumps(r) + "\n")


def test_order_ingest_stream_equals_batch(spark, tmp_dir):
    raw = feeds.landed_a(spark, SF_SMALL)
    recs = [json.loads(r[0]) for r in raw.select(F.to_json(F.struct(*raw.columns))).collect()]
    land = f"{tmp_dir}/landing"
    # three collections, then a later one repeating orders with a changed status
    changed = [dict(r, order_status="R40") for r in recs[:5]]
    files = [recs[i::3] for i in range(3)] + [changed]
    for i, part in enumerate(files):
        _write_lines(f"{land}/collect-{i}.json", part)
        os.utime(f"{land}/collect-{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    table, summary, history = f"{tmp_dir}/orders", f"{tmp_dir}/summary", f"{tmp_dir}/history"
    q = ingest.order_ingest(spark, land, table, f"{tmp_dir}/ckpt", summary, history, max_files=1)
    q.awaitTermination()
    got = spark.read.parquet(table).drop("order_month", "ingest_seq")

    batches = [nz.normalize_a(spark.read.schema(feeds.ORDER_A).json(f"{land}/collect-{i}.json"), ingest_seq=str(i))
               for i in range(len(files))]
    union = batches[0]
    for b in batches[1:]:
        union = union.unionByName(b)
    expect = last_wins(union, ["id"], ["ingest_seq"]).drop("ingest_seq")
    a = sorted(tuple(r) for r in got.select(*sorted(got.columns)).collect())
    b = sorted(tuple(r) for r in expect.select(*sorted(expect.columns)).collect())
    assert a == b
    changed_ids = [str(r["order_id"]) for r in changed]
    assert {r.status for r in got.where(F.col("order_id").isin(changed_ids)).collect()} == {"R40"}
    runs = spark.read.parquet(history)
    assert runs.selectExpr("sum(total_saved)").first()[0] == sum(b.select("id").distinct().count() for b in batches)
    assert runs.count() == 4 and runs.where("channels_json LIKE '%success%'").count() == 4
    # the incrementally refreshed summary equals a full recomputation
    from ledgerline.operators.sales import daily_summary
    full = daily_summary(spark.read.parquet(table), "A")
    inc = spark.read.parquet(summary).select(*full.columns)
    assert sorted(tuple(r) for r in inc.collect()) == sorted(tuple(r) for r in full.collect())


def test_window_stream_equals_batch_and_drops_repeats(spark, tmp_dir):
    ev = ingest.event_time(spark.read.parquet(f"{SF_SMALL}/events.parquet"))
    src = f"{tmp_dir}/events"
    ev.where("event_id % 2 = 0").write.parquet(f"{src}/p=0")
    ev.where("event_id % 2 = 1").write.parquet(f"{src}/p=1")
    ev.where("event_id % 10 = 0").write.parquet(f"{src}/p=2")      # repeats
    from pyspark.sql import types as T
    schema = T.StructType(ev.schema.fields + [T.StructField("p", T.IntegerType())])
    stream = ingest.event_stream(spark, src, schema, watermark="1 day", max_files=1)
    dedup = ingest.dedupe_events(stream)
    out = f"{tmp_dir}/daily"
    q = ingest.start_window_stream(dedup, ingest.daily_sales_windows, out, f"{tmp_dir}/ck2")
    q.awaitTermination()
    got = spark.read.parquet(out)
    want = ingest.daily_sales_windows(ev)
    # append mode emits a window once the watermark (max event time - 1 day)
    # passes its end: the last two days are still open; the rest are final
    # and must equal the batch result
    days = sorted({r.day for r in want.select("day").collect()})
    final = days[:-2]
    a = sorted(tuple(r) for r in got.where(F.col("day").isin(final)).select("day", "event_type", "events").collect())
    b = sorted(tuple(r) for r in want.where(F.col("day").isin(final)).select("day", "event_type", "events").collect())
    assert a == b and len(a) > 0
    assert got.where(~F.col("day").isin(final)).count() <= 5 * 2
    assert dt  # keep import


def _order(i, status, **more):
    return dict({"order_id": str(i), "order_date": "2001-01-05", "order_status": status, "payment_amount": "5"}, **more)


def test_last_arrival_wins_inside_one_trigger_and_rejects_are_kept(spark, tmp_dir):
    land, table = f"{tmp_dir}/land", f"{tmp_dir}/orders"
    _write_lines(f"{land}/z.json", [_order(1, "N40"), _order(2, "R40"), _order(2, "C40"), {"order_status": "N10"}])
    _write_lines(f"{land}/a.json", [_order(1, "C40")])              # collected later, sorts first by name
    os.utime(f"{land}/z.json", (1_700_000_000, 1_700_000_000))
    os.utime(f"{land}/a.json", (1_700_000_100, 1_700_000_100))
    ingest.order_ingest(spark, land, table, f"{tmp_dir}/ck", history=f"{tmp_dir}/h").awaitTermination()
    assert sorted((r.id, r.status) for r in spark.read.parquet(table).collect()) == [("A_1", "C40"), ("A_2", "C40")]
    rejects = spark.read.parquet(f"{table}_rejects")
    assert [(r.status, r.batch_id) for r in rejects.collect()] == [("N10", 0)]


def test_failed_batch_is_recorded_raised_and_retried(spark, tmp_dir, monkeypatch):
    import pytest
    land, table, history = f"{tmp_dir}/land", f"{tmp_dir}/orders", f"{tmp_dir}/h"
    _write_lines(f"{land}/a.json", [_order(5, "N10")])
    real = ingest.sinks.upsert_orders
    monkeypatch.setattr(ingest.sinks, "upsert_orders", lambda *a, **k: (_ for _ in ()).throw(ValueError("x" * 900)))
    with pytest.raises(Exception):
        ingest.order_ingest(spark, land, table, f"{tmp_dir}/ck", history=history).awaitTermination()
    failed = spark.read.parquet(history).collect()
    assert len(failed) == 1 and "x" * 900 in failed[0].channels_json
    monkeypatch.setattr(ingest.sinks, "upsert_orders", real)
    ingest.order_ingest(spark, land, table, f"{tmp_dir}/ck", history=history).awaitTermination()
    assert [r.id for r in spark.read.parquet(table).collect()] == ["A_5"]
    runs = spark.read.parquet(history).collect()
    assert len(runs) == 1 and "success" in runs[0].channels_json


def test_channels_b_and_c_share_the_table(spark, tmp_dir):
    table = f"{tmp_dir}/orders"
    _write_lines(f"{tmp_dir}/B/x.json", [{"orderId": "7", "orderedAt": "2001-01-02", "status": "N10", "orderPrice": "3"}])
    c = {"productOrderId": "8", "orderDate": "2001-01-03", "totalPaymentAmount": "4"}
    _write_lines(f"{tmp_dir}/C/search_status=CANCELED/x.json", [c])
    _write_lines(f"{tmp_dir}/C/search_status=PAYED/x.json", [c])
    os.utime(f"{tmp_dir}/C/search_status=CANCELED/x.json", (1_700_000_000, 1_700_000_000))
    for ch in (nz.CHANNEL_B, nz.CHANNEL_C):
        ingest.order_ingest(spark, f"{tmp_dir}/{ch}", table, f"{tmp_dir}/ck{ch}", channel=ch).awaitTermination()
    got = sorted((r.channel, r.order_id, r.status) for r in spark.read.parquet(table).collect())
    assert got == [(nz.CHANNEL_B, "7", "N10"), (nz.CHANNEL_C, "8", "CANCELED")]
