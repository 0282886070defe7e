"""Benchmark the headline report plans.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Phases:
* ``stage`` -- the ingest side: upserted order lines, stock table and the
  landed channel feeds are derived from the driver tables and written to the
  shared folder once (what the streaming/batch ingest keeps current);
* each headline plan is built and run to the ``noop`` sink: one cold run,
  then ``BENCH_RUNS`` timed runs (median reported).  Plan construction is
  included in the time;
* ``ingest`` -- one run of the K1 upserts and of a T1 stream trigger, not part of the total.

Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    from ledgerline.session import build_session
    spark = build_session(master=f"local[{cpus}]", app="ledgerline-bench", shuffle_partitions=max(8, 2 * cpus))

    from ledgerline.plans import all_plans
    from ledgerline.sources import feeds
    from ledgerline.sources import fixtures as fx

    t0 = time.time()
    fx.orders_table(spark, sf_dir)
    fx.inventory(spark, sf_dir)
    for f in (feeds.landed_a, feeds.landed_b, feeds.landed_c, feeds.landed_products):
        f(spark, sf_dir)
    stage = time.time() - t0

    plans = {n: p for n, p in all_plans().items() if p.headline}
    only = [x for x in os.environ.get("BENCH_ONLY", "").split(",") if x]
    if only:
        plans = {n: p for n, p in plans.items() if n in only}
    out: dict[str, float] = {}
    cold: dict[str, float] = {}
    for name, p in sorted(plans.items()):
        times = []
        for i in range(runs + 1):
            s = time.time()
            p.build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            d = time.time() - s
            if i == 0:
                cold[name] = round(d, 3)
            else:
                times.append(d)
        out[name] = round(statistics.median(times), 3)
    # the write side, once each: upserts into a fresh table, one stream trigger
    ingest: dict[str, float] = {}
    for name in ("k01_upsert_stored", "t01_order_ingest"):
        if not only or name in only:
            s = time.time()
            all_plans()[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            ingest[name] = round(time.time() - s, 3)
    total = round(sum(out.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_plans_total_warm_median", "value": total, "unit": "sec",
                      "queries": out, "cold": cold, "ingest": ingest, "stage_sec": round(stage, 3), "sf": sf, "cpus": cpus,
                      "runs": runs}))


if __name__ == "__main__":
    main()
