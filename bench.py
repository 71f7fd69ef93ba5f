"""Benchmark: build the warehouse once, then time every registered query.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEAT (default 1 timed run after one warm-up), BENCH_QUERIES (comma
list to restrict).  Prints ONE JSON line:
{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}

The warehouse (derived star schema, incl. the SCD2 price history) is written
once to parquet in the session's checkpoint folder -- as the reference's
loaders fill its database once -- and its build time is reported as
``warehouse_build``.  Each query then reads the stored tables; its result is
consumed with a ``noop`` write (all rows computed, nothing collected).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None

    from ludex.session import checkpoint_dir, get_spark
    from ludex.plans.registry import load_all
    from ludex.sources.warehouse import build, materialize

    scratch = tempfile.mkdtemp(prefix="ludex-bench-", dir=os.environ.get("LUDEX_SCRATCH", "/tmp"))
    spark = get_spark(f"local[{cpus}]", app="ludex-bench", shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", max(8, cpus * 2))),
                      extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
                             "spark.checkpoint.dir": os.path.join(scratch, "ckpt"),
                             "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024)})
    checkpoint_dir(spark)

    t0 = time.time()
    wh = build(spark, sf_dir)
    stored = materialize(wh, os.path.join(scratch, "warehouse"))
    build_sec = time.time() - t0
    stored.raw = wh.raw  # queries that parse feeds read the raw tables too

    reg = load_all()
    names = only or list(reg)
    times, errors = {}, {}
    for name in names:
        fn, _ = reg[name]
        runs = []
        try:
            for i in range(repeat + 1):
                s = time.time()
                fn(stored).write.format("noop").mode("overwrite").save()
                if i > 0 or repeat == 0:
                    runs.append(time.time() - s)
            times[name] = round(statistics.median(runs), 3)
        except Exception as e:  # keep going; report the failure
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
    total = round(sum(times.values()), 3)
    out = {
        "metric": "sum_of_query_seconds",
        "value": total,
        "unit": "sec",
        "queries": times,
        "warehouse_build": round(build_sec, 3),
        "sf": sf,
        "n_queries": len(times),
        "cpus": cpus,
        "spark": spark.version,
        "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
    }
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
