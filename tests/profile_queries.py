"""Per-query stages, tasks and shuffle bytes from Spark's event log.

python tests/profile_queries.py <sf_dir> <scratch_dir> [names...]

Runs each registered query once through the ``noop`` sink with the event log
written under ``scratch_dir`` (the Spark UI stays off), then prints one line per
query: seconds, jobs, stages, tasks, shuffle bytes written, input bytes read.
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from terrapanel.plans.catalog import load_all  # noqa: E402


def _events(folder: str):
    import zstandard

    for f in sorted(glob.glob(os.path.join(folder, "*", "events_*"))):
        raw = open(f, "rb").read()
        txt = (zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read().decode()
               if f.endswith(".zstd") else raw.decode())
        for line in txt.splitlines():
            yield json.loads(line)


def main() -> None:
    sf, scratch = sys.argv[1], sys.argv[2]
    only = sys.argv[3:]
    ev = os.path.join(scratch, "eventlog")
    os.makedirs(ev, exist_ok=True)
    spark = (SparkSession.builder.master("local[8]").appName("profile")
             .config("spark.ui.enabled", "false").config("spark.eventLog.enabled", "true")
             .config("spark.eventLog.dir", ev).config("spark.sql.shuffle.partitions", "16")
             .config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries = load_all()
    names = only or list(queries)
    queries["country_summary"].fn(spark, sf).write.format("noop").mode("overwrite").save()  # warm-up
    marks = []
    for name in names:
        spark.sparkContext.setJobGroup(name, name)
        t0 = time.perf_counter()
        queries[name].fn(spark, sf).write.format("noop").mode("overwrite").save()
        marks.append((name, round(time.perf_counter() - t0, 2)))
    spark.stop()
    per = {n: {"jobs": 0, "stages": 0, "tasks": 0, "shuffle_write": 0, "input": 0} for n, _ in marks}
    stage_group: dict[int, str] = {}
    for e in _events(ev):
        t = e["Event"]
        if t == "SparkListenerJobStart":
            g = (e.get("Properties") or {}).get("spark.jobGroup.id")
            if g in per:
                per[g]["jobs"] += 1
                for si in e["Stage Infos"]:
                    stage_group[si["Stage ID"]] = g
        elif t == "SparkListenerStageCompleted":
            si = e["Stage Info"]
            g = stage_group.get(si["Stage ID"])
            if g:
                per[g]["stages"] += 1
                per[g]["tasks"] += si["Number of Tasks"]
                for acc in si.get("Accumulables", []):
                    if acc.get("Name") == "internal.metrics.shuffle.write.bytesWritten":
                        per[g]["shuffle_write"] += int(acc["Value"])
                    elif acc.get("Name") == "internal.metrics.input.bytesRead":
                        per[g]["input"] += int(acc["Value"])
    print(f"{'query':32s} {'sec':>6s} {'jobs':>5s} {'stages':>6s} {'tasks':>6s} {'shuffle_KB':>10s} {'input_KB':>9s}")
    for name, sec in marks:
        p = per[name]
        print(f"{name:32s} {sec:6.2f} {p['jobs']:5d} {p['stages']:6d} {p['tasks']:6d} "
              f"{p['shuffle_write'] / 1024:10.1f} {p['input'] / 1024:9.1f}")


if __name__ == "__main__":
    main()
