"""Benchmark: time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full into the ``noop`` sink (no driver collect);
the best of $BENCH_REPEAT (default 3) runs is reported.  Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    from cadence.session import get_spark
    from cadence.plans.bench_queries import headline
    spark = get_spark("cadence-bench", cpus, shuffle_partitions=int(cpus) * 2)
    spark.range(1000).selectExpr("sum(id)").collect()  # JVM warm-up
    times = {}
    for name, fn in headline().items():
        best = None
        for _ in range(repeat):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
