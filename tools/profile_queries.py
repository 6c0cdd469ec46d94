"""Per-query jobs, stages, tasks, shuffle bytes and input rows, read from
Spark's event log (written to a fresh scratch folder; the UI stays off).

    python tools/profile_queries.py [--sf-dir DIR] [--only k1,k2] [--cpus 8]

Each registered query runs in full through the ``noop`` sink under its own
job description; the event log is then parsed and one line per query is
printed, slowest first.
"""

from __future__ import annotations

import argparse
import collections
import glob
import io
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _events(log_dir: str):
    import zstandard
    for path in sorted(glob.glob(os.path.join(log_dir, "eventlog_v2_*", "events_*"))):
        with open(path, "rb") as fh:
            stream = zstandard.ZstdDecompressor().stream_reader(fh) if path.endswith(".zstd") else fh
            for line in io.TextIOWrapper(stream, encoding="utf-8"):
                yield json.loads(line)


def summarize(log_dir: str) -> dict[str, dict]:
    stage_key: dict[int, str] = {}
    out: dict[str, dict] = collections.defaultdict(
        lambda: {"jobs": 0, "stages": 0, "tasks": 0, "shuffle_write_bytes": 0, "input_rows": 0})
    seen_stages = set()
    for e in _events(log_dir):
        kind = e["Event"]
        if kind == "SparkListenerJobStart":
            key = (e.get("Properties") or {}).get("spark.job.description")
            if key:
                out[key]["jobs"] += 1
                for s in e["Stage IDs"]:
                    stage_key[s] = key
        elif kind == "SparkListenerTaskEnd":
            key = stage_key.get(e["Stage ID"])
            if not key:
                continue
            m = e.get("Task Metrics") or {}
            out[key]["tasks"] += 1
            out[key]["shuffle_write_bytes"] += m.get("Shuffle Write Metrics", {}).get("Shuffle Bytes Written", 0)
            out[key]["input_rows"] += m.get("Input Metrics", {}).get("Records Read", 0)
            if e["Stage ID"] not in seen_stages:
                seen_stages.add(e["Stage ID"])
                out[key]["stages"] += 1
    return out


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.1")
    ap.add_argument("--only", default="")
    ap.add_argument("--cpus", type=int, default=8)
    args = ap.parse_args()

    from martlet.session import build_session
    from martlet.suite import QUERIES

    log_dir = tempfile.mkdtemp(prefix="martlet-eventlog-")
    input_bytes = sum(os.path.getsize(os.path.join(r, f)) for r, _, fs in os.walk(args.sf_dir) for f in fs)
    spark = build_session(master=f"local[{args.cpus}]", input_bytes=input_bytes, total_cores=args.cpus,
                          extra_conf={"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir})
    only = [k for k in args.only.split(",") if k]
    QUERIES["q_top_products"](spark, args.sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for key, fn in QUERIES.items():
        if only and key not in only:
            continue
        spark.sparkContext.setJobDescription(key)
        t0 = time.perf_counter()
        fn(spark, args.sf_dir).write.format("noop").mode("overwrite").save()
        seconds[key] = time.perf_counter() - t0
    spark.sparkContext.setJobDescription(None)
    spark.stop()

    stats = summarize(log_dir)
    print(f"{'sec':>6} {'jobs':>4} {'stages':>6} {'tasks':>6} {'shuffle_MB':>10} {'input_rows':>10}  key")
    for key, sec in sorted(seconds.items(), key=lambda kv: -kv[1]):
        s = stats[key]
        print(f"{sec:6.2f} {s['jobs']:4d} {s['stages']:6d} {s['tasks']:6d} "
              f"{s['shuffle_write_bytes'] / 1e6:10.1f} {s['input_rows']:10d}  {key}")
    print(f"event log: {log_dir}")


if __name__ == "__main__":
    main()
