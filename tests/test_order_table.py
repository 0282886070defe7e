"""K1's stored table: index look-ups, committed swaps, recovery after a stop at any step."""

import datetime as dt
import random

import pytest

from ledgerline.functions.rules import order_month
from ledgerline.sinks import files, order_table

LINE = "id string, channel string, order_id string, order_date date, status string, ingest_seq bigint"
DAYS = [None, *(dt.date(2024, m, 5) for m in range(1, 7))]


def lines(spark, rows):
    return spark.createDataFrame(rows, LINE)


def row(i, day, seq, status="N10", channel="A"):
    return (f"{channel}_{i}", channel, str(i // 3), day, status, seq)


def table(spark, path):
    return sorted((r.id, str(r.order_date), r.status, r.order_month) for r in order_table.read_orders(spark, path).collect())


def plain(spark, path):
    return sorted((r.id, str(r.order_date), r.status, r.order_month) for r in spark.read.parquet(path).collect())


def month(day):
    return day.year * 100 + day.month if day else 0


def test_random_batches_equal_a_dictionary(spark, tmp_dir):
    rng, path, want = random.Random(5), f"{tmp_dir}/orders", {}
    for n in range(7):
        batch = [row(rng.randrange(60), rng.choice(DAYS), seq, rng.choice(["N10", "C40"]), rng.choice("AB")) for seq in range(rng.randrange(1, 30))]
        got = order_table.upsert_orders(spark, path, lines(spark, batch), index_rows=8)
        last = {r[0]: r for r in sorted(batch, key=lambda r: r[-1])}
        want |= last
        assert (got["batch_rows"], got["batch_lines"]) == (len(batch), len(last))
        expect = sorted((r[0], str(r[3]), r[4], month(r[3])) for r in want.values())
        assert table(spark, path) == expect == plain(spark, path)
        if n == 3:
            order_table.rebuild_index(spark, path, index_rows=8)
    assert order_table._generation(spark, path)[1] > 4
    known = {(r.key, r.channel, r.order_month) for r in spark.read.parquet(order_table._generation(spark, path)[0]).collect()}
    assert {(f"i:{r[0]}", r[1], month(r[3])) for r in want.values()} <= known


@pytest.fixture()
def three(spark, tmp_dir):
    """A table over three months, and a batch that moves, changes and adds lines."""
    path = f"{tmp_dir}/orders"
    order_table.upsert_orders(spark, path, lines(spark, [row(i, DAYS[1 + i % 3], 0) for i in range(30)]), index_rows=4)
    batch = [row(0, DAYS[4], 1, "E40"), row(1, DAYS[2], 1, "C40"), row(90, DAYS[1], 1), *(row(i, DAYS[1], 1) for i in range(2, 30, 3))]
    return path, lines(spark, batch)


class Stop(Exception):
    pass


STEPS = [("delete", n) for n in (3, 4, 5, 6)] + [("move", n) for n in (1, 2, 3, 4, 5, 6)] + [("write_json", 1)]


def test_a_stop_at_any_step_loses_nothing(spark, tmp_dir, three, monkeypatch):
    """Before the commit the table is the old one, after it the new one, and a retry ends with the new one."""
    path, batch = three
    old = table(spark, path)
    import shutil
    done = f"{tmp_dir}/done"
    shutil.copytree(path, done)
    order_table.upsert_orders(spark, done, batch)
    new = table(spark, done)
    assert new != old and not [r for r in new if r[3] == 202403] and [r for r in old if r[3] == 202403]
    seen = set()
    for k, (step, nth) in enumerate(STEPS):
        copy = f"{tmp_dir}/copy-{k}"
        shutil.copytree(path, copy)
        real, calls = getattr(files, step), []

        def stopping(*a, real=real, calls=calls, nth=nth):
            calls.append(a)
            if len(calls) == nth:
                raise Stop
            return real(*a)

        monkeypatch.setattr(files, step, stopping)
        try:
            order_table.upsert_orders(spark, copy, batch)
        except Stop:
            pass
        else:
            continue
        finally:
            monkeypatch.setattr(files, step, real)
        committed = bool(order_table._pending(spark, copy)) or plain(spark, copy) == new
        assert table(spark, copy) == (new if committed else old), (step, nth)
        seen.add((committed, plain(spark, copy) in (old, new)))
        order_table.upsert_orders(spark, copy, batch)
        assert table(spark, copy) == new == plain(spark, copy)
        assert files.names(spark, f"{copy}/_commits") == []
    # stopped before the commit, after it, and between the removal of a folder and the rename that replaces it
    assert {(False, True), (True, True), (True, False)} <= seen


def test_recovery_finishes_a_committed_batch(spark, three, monkeypatch):
    path, batch = three
    monkeypatch.setattr(order_table, "_finish", lambda *a: (_ for _ in ()).throw(Stop()))
    with pytest.raises(Stop):
        order_table.upsert_orders(spark, path, batch)
    monkeypatch.undo()
    before = table(spark, path)
    assert plain(spark, path) != before
    assert order_table.recover_orders(spark, path) == 1
    assert plain(spark, path) == before and order_table.recover_orders(spark, path) == 0


def test_lookup_reads_the_buckets_of_the_batch_only(spark, three):
    path, _ = three
    order_table.rebuild_index(spark, path, index_rows=2)
    folder, buckets = order_table._generation(spark, path)
    assert buckets >= 16
    keys = order_table._entries(lines(spark, [row(7, None, 1)]).withColumn("order_month", order_month())).where("key LIKE 'i:%'")
    found = order_table.lookup(spark, path, keys)
    assert [(r.was_channel, r.was_month) for r in found.collect()] == [("A", 202402)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:60] and "/_index/" in plan
    assert all("/_index/" in scan.split("PushedFilters")[0] for scan in plan.split("FileScan parquet")[1:])
    assert plan.split("PartitionFilters: [")[1].split("]")[0].count(",") + 1 < buckets


def test_a_batch_reads_no_partition_it_does_not_touch(spark, three, monkeypatch):
    """The stored rows are read with a filter on the touched partitions."""
    path, _ = three
    read = []
    real = order_table.in_parts
    monkeypatch.setattr(order_table, "in_parts", lambda parts: read.append(sorted(parts)) or real(parts))
    got = order_table.upsert_orders(spark, path, lines(spark, [row(4, DAYS[2], 5)]))
    assert read == [[("A", 202402)]] == [got["partitions"]] and got["rows_written"] == 10


def test_replace_by_order_finds_other_months(spark, tmp_dir):
    path = f"{tmp_dir}/orders"
    order_table.upsert_orders(spark, path, lines(spark, [row(i, DAYS[1 + i], 0) for i in range(3)] + [row(5, DAYS[1], 0)]))
    order_table.upsert_orders(spark, path, lines(spark, [("A_new", "A", "0", DAYS[6], "N10", 1)]), replace_by_order=True)
    assert [r[0] for r in table(spark, path)] == ["A_5", "A_new"]


def test_odd_channel_names_and_empty_batches(spark, tmp_dir):
    path = f"{tmp_dir}/orders"
    assert order_table.upsert_orders(spark, path, lines(spark, []))["partitions"] == []
    for n in range(2):
        order_table.upsert_orders(spark, path, lines(spark, [(f"x{c}", c, "1", DAYS[1 + n], "N10", n) for c in ("a b", "c=d/e", "é:%", "")]))
        assert sorted((r.channel, r.order_month) for r in order_table.read_orders(spark, path).collect()) == [
            (c, 202401 + n) for c in ("a b", "c=d/e", "unknown", "é:%")]
    assert order_table.upsert_orders(spark, path, lines(spark, []))["rows_written"] == 0


def test_old_tables_get_an_index(spark, three):
    """A table written before there was an index."""
    path, batch = three
    files.delete(spark, f"{path}/_index")
    order_table.upsert_orders(spark, path, batch)
    assert order_table._generation(spark, path) is not None
    assert not [r for r in table(spark, path) if r[3] == 202403]
