"""Run every registered query against its oracle: python tests/run_oracles.py [sf_dir] [names...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import compare, duck  # noqa: E402

from terrapanel.plans.catalog import load_all  # noqa: E402
from terrapanel.session import get_spark  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    spark = get_spark("oracles")
    con = duck(sf)
    bad = 0
    for name, q in load_all().items():
        if only and name not in only:
            continue
        t0 = time.time()
        if q.sql is None:
            n = q.fn(spark, sf).count()
            print(f"{name:34s} rows-only  rows={n}  {time.time()-t0:.1f}s", flush=True)
            continue
        try:
            r = compare(spark, con, name, q.fn, q.sql, sf)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"{name:34s} ERROR {type(e).__name__}: {str(e)[:400]}", flush=True)
            continue
        ok = r["hash_match"] and r["spark_rows"] == r["duck_rows"]
        bad += not ok
        extra = "" if ok else f" {r.get('cols') or r.get('diff')}"
        print(f"{name:34s} {'OK ' if ok else 'BAD'} rows={r['spark_rows']}/{r['duck_rows']} "
              f"{time.time()-t0:.1f}s{extra}", flush=True)
    print("FAILED", bad)


if __name__ == "__main__":
    main()
