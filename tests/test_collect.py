"""Collections of day ranges, the last day's report, runs over all channels, marked export files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerline.sinks import tables as sinks
from ledgerline.streaming import ingest


def _order(i, status, day="2001-01-05", **more):
    return dict({"order_id": str(i), "order_date": day, "order_status": status, "payment_amount": "5"}, **more)


def _files(folder, files):
    os.makedirs(folder, exist_ok=True)
    for n, (name, seconds, records) in enumerate(files):
        with open(f"{folder}/{name}", "w") as f:
            f.write("".join(json.dumps(r) + "\n" for r in records))
        os.utime(f"{folder}/{name}", (1_700_000_000 + seconds, 1_700_000_000 + seconds))


def _table(spark, path):
    return sorted((r.order_id, r.status) for r in sinks.read_orders(spark, path).collect())


def test_windows():
    assert ingest.collect_window("2001-03-01") == ("2001-02-28", "2001-03-01")
    assert ingest.collect_window("2001-03-01", days=7) == ("2001-02-22", "2001-03-01")
    assert ingest.collect_window("2001-03-01", days=400) == ("2001-01-30", "2001-03-01")
    assert ingest.collect_window("2001-03-01", days=0) == ("2001-02-28", "2001-03-01")
    assert ingest.collect_window("", start="2001-01-01", end="2001-01-31") == ("2001-01-01", "2001-01-31")
    for start, end in (("2001-01-01", "2001-02-01"), ("2001-01-02", "2001-01-01")):
        with pytest.raises(ValueError):
            ingest.collect_window("", start=start, end=end)


def test_a_collection_neither_doubles_nor_reverts(spark, tmp_dir):
    table = f"{tmp_dir}/orders"
    _files(f"{tmp_dir}/live", [("a.json", 100, [_order(1, "R40"), _order(2, "N10")])])
    _files(f"{tmp_dir}/old", [("x.json", 10, [_order(1, "N10"), _order(3, "N10"), _order(4, "N10", "2001-03-01")]),
                              ("y.json", 200, [_order(2, "C40")])])
    ingest.order_ingest(spark, f"{tmp_dir}/live", table, f"{tmp_dir}/ck").awaitTermination()
    for run in range(2):
        got = ingest.collect_days(spark, f"{tmp_dir}/old", table, "2001-01-01", "2001-01-31", run, history=f"{tmp_dir}/h")
        assert _table(spark, table) == [("1", "R40"), ("2", "C40"), ("3", "N10")]
        assert got["batch_lines"] == 3
    assert spark.read.parquet(f"{tmp_dir}/h").count() == 2
    # the stream goes on: a later file wins again
    _files(f"{tmp_dir}/live", [("b.json", 300, [_order(3, "R40")])])
    ingest.order_ingest(spark, f"{tmp_dir}/live", table, f"{tmp_dir}/ck").awaitTermination()
    assert _table(spark, table) == [("1", "R40"), ("2", "C40"), ("3", "R40")]


def test_last_day_is_two_calendar_days(spark, tmp_dir):
    table, report = f"{tmp_dir}/orders", f"{tmp_dir}/report"
    days = ["2001-01-02", "2001-01-03", "2001-01-04"]
    _files(f"{tmp_dir}/live", [("a.json", 0, [_order(i, "N10", d) for i, d in enumerate(days)] + [_order(9, "C40", days[2])])])
    ingest.order_ingest(spark, f"{tmp_dir}/live", table, f"{tmp_dir}/ck", last_day=report).awaitTermination()
    assert [(r.as_of, r.order_count, r.total_amount) for r in spark.read.parquet(report).collect()] == [("2001-01-04", 2, 10.0)]
    ingest.report_last_day(spark, table, report, "orders-A", 0, days[1])        # the same batch again
    assert [(r.as_of, r.order_count) for r in spark.read.parquet(report).collect()] == [("2001-01-03", 2)]


def test_a_failing_channel_fails_alone(spark, tmp_dir):
    _files(f"{tmp_dir}/A", [("a.json", 0, [_order(1, "N10"), _order(2, "N10")])])
    got = ingest.collect_all(spark, {"A": f"{tmp_dir}/A", "B": f"{tmp_dir}/none"}, f"{tmp_dir}/orders", f"{tmp_dir}/ck", f"{tmp_dir}/h", run=4)
    assert got["failed"] == ["B"]
    run = sinks.run_history(spark, f"{tmp_dir}/h").first()
    assert (run.batch_id, run.total_saved) == (4, 2)
    assert [(c.channel, c.status, c.saved) for c in run.channels] == [("A", "success", 2), ("B", "failed", 0)]
    assert run.channels[1].error


def test_marked_files(spark, tmp_dir):
    rows = spark.createDataFrame([(str(i), 'say "hi", you' if i % 2 else None) for i in range(40)], "a string, b string").repartition(3)
    sinks.export_csv(rows, f"{tmp_dir}/x", ["번호", 'b"c'], bom=True)
    files = [f"{tmp_dir}/x/{n}" for n in os.listdir(f"{tmp_dir}/x") if n.startswith("part-")]
    assert len(files) == 3
    lines = []
    for f in files:
        data = open(f, "rb").read()
        assert data.startswith('﻿"번호","b""c"\n'.encode()) and data.count("﻿".encode()) == 1
        lines += data.decode().splitlines()[1:]
    assert sorted(lines) == sorted(f'"{i}","say ""hi"", you"' if i % 2 else f'"{i}",""' for i in range(40))
    assert F
