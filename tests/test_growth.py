"""Steps whose shuffles, files or candidates grew faster than their tables."""

import datetime as dt
import gzip
import json
import os

from pyspark.sql import functions as F

from ledgerline.operators import stock
from ledgerline.plans import all_plans, collect_plans, sink_plans
from ledgerline.sinks import order_table
from ledgerline.sources import feeds
from ledgerline.sources import fixtures as fx
from ledgerline.streaming import ingest

from fixture_paths import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_batch_of_distinct_ids_is_stored_without_a_window(spark, tmp_dir, monkeypatch):
    seen = []
    monkeypatch.setattr(order_table, "last_wins", lambda *a: seen.append(a))
    rows = spark.createDataFrame([("A_1", "A", "1", None, "N10"), ("A_2", "A", "2", None, "N10")],
                                 "id string, channel string, order_id string, order_date date, status string")
    got = order_table.upsert_orders(spark, f"{tmp_dir}/t", rows, order=None)
    assert not seen and got["batch_rows"] == got["batch_lines"] == got["rows_written"] == 2
    assert sorted(r.id for r in order_table.read_orders(spark, f"{tmp_dir}/t").collect()) == ["A_1", "A_2"]


def _tables(spark, path):
    """Repeated lines, lines without a number, and keys that are missing on one side."""
    spark.createDataFrame([(1, 1, 5, 1, 2.0, 10.0, "N", "2001-01-02"), (1, 1, 5, 1, 3.0, 11.0, "R", "2001-01-03"),
                           (1, 9, 5, 1, 4.0, 12.0, "N", "2001-01-09"), (1, 2, 6, None, 1.0, 5.0, "N", "2001-02-01"),
                           (2, 2, 6, None, 1.0, 6.0, "N", "2001-01-01"), (2, 1, 7, 2, 1.0, 7.0, "A", "2001-01-01"),
                           (3, 1, 7, 1, 1.0, 7.0, "A", "2001-01-01")],
                          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                          "l_extendedprice double, l_returnflag string, l_shipdate string").write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(1, 1, "F", "2001-01-01"), (2, 1, "O", "2001-01-02"), (3, 8, "O", "2001-01-02")],
                          "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate string").write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame([(1, "one"), (2, "two")], "p_partkey long, p_name string").write.parquet(f"{path}/part.parquet")
    spark.createDataFrame([(1, "c")], "c_custkey long, c_name string").write.parquet(f"{path}/customer.parquet")


def test_stored_lines_hold_an_id_once(spark, tmp_dir):
    _tables(spark, tmp_dir)
    got = sorted((r.id, r.order_id, r.status, r.quantity, r.amount, r.product_name) for r in fx.orders_table(spark, tmp_dir).collect() if r.id)
    # the latest line's part is not there: the one before it counts; order 3 has no customer
    assert got == [("market_1_1", "1", "RETURNED", 3, 11.0, "one"), ("store_2_2", "2", "E40", 1, 7.0, "one")]
    assert fx.orders_table(spark, tmp_dir).where("id IS NULL").count() == 1
    assert fx.upsert_lines(spark, tmp_dir).where("id IS NULL").count() == 2


def test_lines_are_shuffled_narrow(spark):
    """No text made of the keys goes through the joins and the de-duplication."""
    plan = fx.stored_lines(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Window"):].split("Union")[0]
    assert "concat(" not in below.split("Window", 1)[1].split("Join", 1)[0]


def test_landed_feeds_are_compressed(spark):
    for feed in (feeds.landed_a, feeds.landed_b, feeds.landed_c):
        held = feed(spark, SF_SMALL).inputFiles()
        assert held and all(x.endswith(".gz") for x in held)


def test_near_records_are_landed_without_a_shuffle(spark, tmp_dir):
    days = spark.range(600, numPartitions=3).select(
        F.concat(F.lit("2001-0"), (F.col("id") % 3 + 1).cast("string"), F.lit("-05T00:00:00")).alias("orderedAt"), F.col("id").cast("string").alias("orderId"))
    feeds.land_orders(days, tmp_dir, "B", "month", near=True)
    months = sorted(x for x in os.listdir(tmp_dir) if "=" in x)
    assert months == [f"order_day=2001-0{m}-01" for m in (1, 2, 3)]
    for m in months:        # a file of every task that read the rows, each of one month only
        held = [x for x in os.listdir(f"{tmp_dir}/{m}") if x.endswith(".json.gz")]
        assert len(held) == 3
        assert all(m[10:17] in line for x in held for line in gzip.open(f"{tmp_dir}/{m}/{x}", "rt"))
    assert feeds.read_orders_b(spark, tmp_dir).distinct().count() == 600
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_landing_steps_have_files_by_size(spark, tmp_dir, monkeypatch):
    raw = feeds.landed_a(spark, SF_SMALL)
    assert collect_plans._files(raw) == collect_plans.FILES
    monkeypatch.setattr(collect_plans, "FILE_BYTES", 4096)
    n = collect_plans._files(raw)
    assert n > 3
    collect_plans._land(raw, f"{tmp_dir}/l", n)
    assert len([x for x in os.listdir(f"{tmp_dir}/l") if x.startswith("part-")]) == n
    # two steps of so many files are still two triggers
    got = all_plans()["t02_last_day_sales"].build(spark, SF_SMALL)
    assert sorted({r.batch for r in got.collect()}) == ["0", "1"]


def test_repeated_names_are_matched_once(spark):
    """Sixty rows and sixty items of one name: their pairs are not formed."""
    page = spark.range(60).select((F.col("id") + 1).alias("no"), F.lit(None).cast("string").alias("code"), F.lit("").alias("barcode"),
                                  F.lit("cap blue").alias("name"), F.lit("size opt").alias("option"),
                                  F.lit(0).cast("bigint").alias("opening"), F.lit(0).cast("bigint").alias("outgoing"), F.lit(0).cast("bigint").alias("closing"))
    items = spark.range(60).select(F.concat(F.lit("k"), "id").alias("key"), F.lit("cap blue").alias("name"), F.lit("opt").alias("option"), F.lit(2).cast("bigint").alias("qty"))
    items = items.unionByName(items.limit(1).withColumns({"key": F.lit("other"), "name": F.lit("cap"), "option": F.lit("none")}))
    out = stock.sync_outgoing(page, items)
    assert sorted((r.no, r.outgoing) for r in out.collect()) == [(1, 122), *((n, 2) for n in range(2, 61))]
    joins = _metric_rows(out)
    assert max(joins) <= 61 * 3, joins


def _metric_rows(df):
    """Rows out of every join of the executed plan."""
    found = []

    def walk(p):
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(p.executedPlan())
        if "Join" in name:
            found.append(p.metrics().apply("numOutputRows").value())
        if name.endswith("QueryStage"):
            walk(p.plan())
        kids = p.children()
        for i in range(kids.size()):
            walk(kids.apply(i))

    q = df._jdf.queryExecution()
    q.executedPlan().executeCollect()
    walk(q.executedPlan())
    return found


# ---- the order table's batches ----------------------------------------------------------------------

LINE = "id string, channel string, order_id string, order_date date, status string, ingest_seq bigint"
DAY = [dt.date(2024, m, 5) for m in range(1, 5)]


def _shuffles(df):
    """The shuffles of the plan, by what they are dealt by."""
    return [line for line in _plan(df).split("\n") if "Exchange hashpartitioning" in line]


def test_a_batch_shuffles_the_stored_rows_once(spark, tmp_dir, monkeypatch):
    """Also where neither side of the replacement can be broadcast."""
    path, made, real = f"{tmp_dir}/t", [], order_table._replaced
    rows = [(f"A_{i}", "A", str(i // 2), DAY[i % 3], "N10", 0) for i in range(30)]
    order_table.upsert_orders(spark, path, spark.createDataFrame(rows, LINE))
    monkeypatch.setattr(order_table, "_replaced", lambda *a: made.append((real(*a), a[-1])) or made[-1][0])
    monkeypatch.setattr(order_table, "SLICE_BYTES", 500)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:        # moved, changed, new, and without an id
        batch = [("A_0", "A", "0", DAY[3], "E40", 1), ("A_1", "A", "0", DAY[1], "C40", 1), ("A_99", "A", "9", DAY[2], "N10", 1), (None, "A", "9", DAY[2], "N10", 1)]
        for _ in range(2):
            got = order_table.upsert_orders(spark, path, spark.createDataFrame(batch, LINE))
        plans = [_shuffles(df) for df, _ in made]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert [len(p) for p in plans] == [1, 1] and all("_slice" in p[0] for p in plans)
    assert all(n > 1 for _, n in made)
    want = {r[0]: (r[3], r[4]) for r in rows + batch if r[0]}
    stored = order_table.read_orders(spark, path).collect()
    assert {r.id: (r.order_date, r.status) for r in stored if r.id} == want
    assert len([r for r in stored if r.id]) == len(want) and sum(r.id is None for r in stored) == 2     # a null id replaces nothing
    assert got["batch_lines"] == 4 and got["partitions"] == [("A", 202401), ("A", 202402), ("A", 202403), ("A", 202404)]


def test_only_repeated_keys_are_shuffled_whole(spark, tmp_dir, monkeypatch):
    rows = [(f"A_{i % 25}", "A", "1", None, str(i), i) for i in range(30)] + [(None, "A", "1", None, "x", i) for i in range(3)]
    df, cut = spark.createDataFrame(rows, LINE), []
    real = order_table.last_wins
    monkeypatch.setattr(order_table, "last_wins", lambda d, *a: cut.append(d.count()) or real(d, *a))
    want = sorted(map(str, real(df, ["id"], ["ingest_seq"]).collect()))
    for n, limit in enumerate((100, 0)):
        monkeypatch.setattr(order_table, "REPEATED_KEYS", limit)
        got = order_table.latest(spark, df, ["id"], ["ingest_seq"], f"{tmp_dir}/{n}")
        assert sorted(map(str, got.collect())) == want
    assert cut == [13, 33]          # five ids twice and the null three times; all rows where too many repeat
    once = order_table.latest(spark, df.where("ingest_seq BETWEEN 10 AND 20 AND id IS NOT NULL"), ["id"], ["ingest_seq"], f"{tmp_dir}/once")
    assert len(cut) == 2 and not _shuffles(once) and once.count() == 11


def test_keys_without_an_entry_are_not_grouped(spark, tmp_dir):
    path, keep = f"{tmp_dir}/t", []
    order_table.upsert_orders(spark, path, spark.createDataFrame([("A_1", "A", "1", DAY[0], "N10", 0)], LINE))
    order_table.upsert_orders(spark, path, spark.createDataFrame([("A_1", "A", "1", DAY[0], "N10", 1)], LINE))
    real = order_table._add_entries
    order_table._add_entries = lambda s, p, entries, work: keep.append(sorted(tuple(r) for r in entries.collect())) or real(s, p, entries, work)
    try:
        order_table.upsert_orders(spark, path, spark.createDataFrame([("A_1", "A", "1", DAY[1], "N10", 2), ("A_2", "A", "1", DAY[0], "N10", 2)], LINE))
    finally:
        order_table._add_entries = real
    assert keep == [[("i:A_1", "A", 202402), ("i:A_2", "A", 202401), ("o:A:1", "A", 202402)]]


def test_a_batch_leaves_nothing_next_to_the_table(spark, tmp_dir):
    order_table.upsert_orders(spark, f"{tmp_dir}/t", spark.createDataFrame([("A_1", "A", "1", DAY[0], "N10", 0)] * 2, LINE))
    assert os.listdir(tmp_dir) == ["t"]


def test_an_ingested_batch_is_cut_to_its_last_lines_narrow(spark, tmp_dir, monkeypatch):
    seen = []
    monkeypatch.setattr(order_table, "last_wins", lambda *a: seen.append(a))
    os.makedirs(f"{tmp_dir}/landing")
    with open(f"{tmp_dir}/landing/a.json", "w") as f:
        f.write("".join(f'{{"order_id": "{i}", "order_date": "2024-01-05", "order_status": "N10"}}\n' for i in range(5)))
    ingest.order_ingest(spark, f"{tmp_dir}/landing", f"{tmp_dir}/t", f"{tmp_dir}/ck").awaitTermination()
    assert not seen and order_table.read_orders(spark, f"{tmp_dir}/t").count() == 5
    assert not [x for x in os.listdir(tmp_dir) if "aside" in x]


def test_a_collected_feed_is_landed_as_it_is_read(spark, tmp_dir, monkeypatch):
    """Compressed, and without a shuffle into few files; the stream keeps the last state of every order."""
    record = F.struct(F.col("id").cast("string").alias("order_id"), F.lit("2001-01-05").alias("order_date"), F.lit("N10").alias("order_status"))
    raw = feeds.parse_json(spark.range(0, 90, 1, 5).select(F.to_json(record).alias("json")), "json", feeds.ORDER_A)
    monkeypatch.setattr(feeds, "landed_a", lambda *a: raw)
    path = sink_plans._collected(spark, tmp_dir)
    held = sorted(x for x in os.listdir(path) if x.startswith("part-"))
    assert len(held) == 15 and all(x.endswith(".json.gz") for x in held)        # three steps of five tasks
    landed = []
    for x in held:
        rows = [json.loads(line) for line in gzip.open(f"{path}/{x}", "rt")]
        landed += [(r.get("order_id"), r["order_status"]) for r in rows]
        assert {int(r["order_id"]) // 18 for r in rows if "order_id" in r} <= {int(x.split("-")[1])}
    every, changed, nameless = [(str(i), "N10") for i in range(90)], [(str(i), "R40") for i in range(0, 90, 5)], [(None, "N10")] * 10
    assert sorted(landed, key=str) == sorted(every + changed + nameless, key=str)
    ingest.order_ingest(spark, path, f"{tmp_dir}/t", f"{tmp_dir}/ck").awaitTermination()
    assert {r.order_id: r.status for r in order_table.read_orders(spark, f"{tmp_dir}/t").collect()} == dict(every + changed)
    assert order_table.read_orders(spark, f"{tmp_dir}/t").count() == 90 and spark.read.parquet(f"{tmp_dir}/t_rejects").count() == 10
