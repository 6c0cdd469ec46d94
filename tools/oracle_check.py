"""Run every registered query on Spark and its oracle SQL on DuckDB at one
scale factor, and report per-key row-count / column / value agreement.

    python tools/oracle_check.py [--sf-dir DIR] [--only k1,k2] [--json out]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import json
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from martlet.session import TABLES, build_session  # noqa: E402


def canon(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat(sep=" ") if isinstance(v, dt.datetime) else v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, canon(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return canon(v.asDict())
    return str(v)


def rows_of(cols, tuples):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(canon(t[i]) for i in order) for t in tuples]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(name, spark, con, sf_dir, fn, sql):
    res = {"key": name}
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    res["spark_sec"] = round(time.time() - t0, 3)
    res["rows"] = len(s_rows)
    if sql is None:
        res["status"] = "rows-only"
        return res
    cur = con.execute(sql)
    d_cols = [d[0] for d in cur.description]
    d_rows = cur.fetchall()
    res["oracle_rows"] = len(d_rows)
    if sorted(s_cols) != sorted(d_cols):
        res["status"] = "COLUMNS"
        res["detail"] = f"spark={s_cols} oracle={d_cols}"
        return res
    if len(s_rows) != len(d_rows):
        res["status"] = "ROWCOUNT"
        return res
    a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
    if a != b:
        res["status"] = "VALUES"
        for x, y in zip(a, b):
            if x != y:
                res["detail"] = f"spark={x!r}\noracle={y!r}"
                break
        return res
    # stricter: raw values (floats bit-exact, decimals exact, no rounding)
    def raw(cols, tuples):
        order = sorted(range(len(cols)), key=lambda i: cols[i])
        out = [tuple(t[i] for i in order) for t in tuples]
        return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))
    ra, rb = raw(s_cols, s_rows), raw(d_cols, d_rows)
    res["exact"] = all(repr(x) == repr(y) or str(x) == str(y) for x, y in zip(ra, rb))
    res["status"] = "OK"
    return res


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    ap.add_argument("--only", default="")
    ap.add_argument("--json", default="")
    args = ap.parse_args()
    from martlet.suite import ORACLE, QUERIES

    spark = build_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{args.sf_dir}/{t}.parquet')")
    keys = [k for k in QUERIES if not args.only or k in args.only.split(",")]
    results = []
    for k in keys:
        try:
            r = compare(k, spark, con, args.sf_dir, QUERIES[k], ORACLE.get(k))
        except Exception as e:  # noqa: BLE001
            r = {"key": k, "status": "ERROR", "detail": "".join(
                traceback.format_exception_only(type(e), e))[-1500:]}
        results.append(r)
        print(json.dumps(r), flush=True)
    bad = [r["key"] for r in results if r["status"] not in ("OK", "rows-only")]
    print(f"== {len(results)} keys, {len(bad)} failing: {bad}")
    if args.json:
        with open(args.json, "w") as f:
            json.dump(results, f, indent=1)


if __name__ == "__main__":
    main()
