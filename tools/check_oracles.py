"""Run registered plans on Spark and their oracle SQL on DuckDB; compare.

    python tools/check_oracles.py [sf_dir] [name-prefix ...]

Prints one line per plan (rows, column names, value match) and a JSON
summary.  Values are compared order-insensitively after normalising
floats to 6 decimals and dates/timestamps to ISO text.
"""

from __future__ import annotations

import datetime as dt
import decimal
import json
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from ledgerline.sources.tables import BASE_TABLES, table_path  # noqa: E402


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET enable_progress_bar = false")
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6) + 0.0
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return float(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    return str(v)


def _cat_spark(t: str) -> str:
    t = t.lower()
    if t in ("bigint", "int", "smallint", "tinyint"):
        return "int"
    if t in ("double", "float") or t.startswith("decimal"):
        return "float"
    if t == "boolean":
        return "bool"
    if t.startswith("timestamp"):
        return "timestamp"
    return {"string": "str", "date": "date"}.get(t, t)


def _cat_duck(t) -> str:
    t = str(t).upper()
    if t in ("BIGINT", "INTEGER", "HUGEINT", "SMALLINT", "TINYINT", "UBIGINT", "UINTEGER"):
        return "int"
    if t in ("DOUBLE", "FLOAT") or t.startswith("DECIMAL"):
        return "float"
    if t == "BOOLEAN":
        return "bool"
    if t.startswith("TIMESTAMP"):
        return "timestamp"
    return {"VARCHAR": "str", "STRING": "str", "DATE": "date"}.get(t, t.lower())


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in records]
    return sorted(out, key=repr)


def compare(spark, con, name, build, sql, sf_dir):
    t0 = time.time()
    sdf = build(spark, sf_dir)
    srows = sdf.collect()
    scols = sdf.columns
    t1 = time.time()
    res = {"name": name, "spark_rows": len(srows), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        res["status"] = "no-oracle"
        return res
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    res["oracle_rows"] = len(drows)
    if sorted(scols) != sorted(dcols):
        res["status"] = f"COLUMNS spark={sorted(scols)} oracle={sorted(dcols)}"
        return res
    st = {c: _cat_spark(t) for c, t in sdf.dtypes}
    dt_ = {d[0]: _cat_duck(d[1]) for d in cur.description}
    diff_types = {c: (st[c], dt_.get(c)) for c in st if st[c] != dt_.get(c)}
    if diff_types:
        res["types"] = diff_types
    a = rows_of(scols, [tuple(r) for r in srows])
    b = rows_of(dcols, drows)
    if len(a) != len(b):
        res["status"] = "ROWCOUNT"
    elif a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        res["status"] = f"VALUES e.g. {diff}"
    else:
        res["status"] = "ok"
    return res


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    prefixes = [a for a in args if not a.startswith("/")]
    from ledgerline.session import build_session
    from ledgerline.plans import all_plans
    spark = build_session(shuffle_partitions=8)
    con = duck(sf_dir)
    results = []
    for name, p in sorted(all_plans().items()):
        if prefixes and not any(name.startswith(x) for x in prefixes):
            continue
        try:
            r = compare(spark, con, name, p.build, p.oracle, sf_dir)
        except Exception as e:  # report and continue
            r = {"name": name, "status": f"ERROR {type(e).__name__}: {str(e)[:300]}"}
        results.append(r)
        print(json.dumps(r), flush=True)
    bad = [r["name"] for r in results if r["status"] not in ("ok", "no-oracle")]
    print(json.dumps({"total": len(results), "bad": bad}))


if __name__ == "__main__":
    main()
