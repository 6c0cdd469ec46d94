"""Benchmark: run every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print ONE JSON line:

    {"metric": "total_query_seconds", "value": N, "unit": "sec",
     "queries": {"q_top_products": sec, ...}, "sf": ...}

Each query is executed in full through the ``noop`` sink (no rows are pulled
into the driver). A warm-up query runs first and is not timed.
Set BENCH_ONLY=k1,k2 to time a subset; BENCH_ORACLE=1 also times the DuckDB
oracle SQL of each key on the same files (reported as ``oracle_duckdb``).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [k for k in os.environ.get("BENCH_ONLY", "").split(",") if k]

    from martlet.session import TABLES, build_session, remove_scratch
    from martlet.suite import ORACLE, QUERIES

    input_bytes = sum(os.path.getsize(os.path.join(root, f))
                      for root, _, files in os.walk(sf_dir) for f in files)
    spark = build_session(master=f"local[{cpus}]", input_bytes=input_bytes, total_cores=int(cpus))
    keys = [k for k in QUERIES if not only or k in only]

    QUERIES["q_top_products"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    failed: dict[str, str] = {}
    for k in keys:
        t0 = time.perf_counter()
        try:
            QUERIES[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[k] = round(time.perf_counter() - t0, 3)
        except Exception as e:  # noqa: BLE001 - report and continue
            failed[k] = str(e).splitlines()[0][:200]

    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": _sf(sf_dir), "cpus": int(cpus), "n_queries": len(times)}
    if failed:
        out["failed"] = failed
    if os.environ.get("BENCH_ORACLE") == "1":
        import duckdb
        con = duckdb.connect()
        con.execute(f"SET threads = {int(cpus)}")
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
        otimes = {}
        for k in keys:
            if k in ORACLE:
                t0 = time.perf_counter()
                con.execute(ORACLE[k]).fetchall()
                otimes[k] = round(time.perf_counter() - t0, 3)
        out["oracle_duckdb"] = {"value": round(sum(otimes.values()), 3), "queries": otimes}
    remove_scratch(spark)
    print(json.dumps(out))


def _sf(path: str):
    m = re.search(r"sf([0-9.]+)", path)
    return float(m.group(1)) if m else path


if __name__ == "__main__":
    main()
