"""Benchmark: headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR.

Prints ONE JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf", ...}.
Each query is executed to completion with the no-op sink (no collect to the
driver); value = sum of per-query medians over BENCH_RUNS warm runs.
Fitted models are not reused between runs (the fit is part of the timing).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "pp", "analysis_locf", "analysis_complete", "visit_gaps", "summarize_detail", "person_years",
    "risk_sets", "km_by", "km_at", "km_summary", "episodes", "cox_score0", "weibull_loglik",
    "cox_fit", "aft_weibull", "aft_ggamma", "relative_hazard",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    from survspan.session import get_spark
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                      extra={"spark.driver.memory": os.environ.get("BENCH_MEM", "7g")})
    from survspan.catalog import models, queries
    qs = queries()
    names = only or HEADLINE
    # warm-up: JVM, Python workers, code shipping
    qs["pp"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        samples = []
        for _ in range(runs):
            models._FITS.clear()
            t0 = time.perf_counter()
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(samples), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "sum_median_query_sec", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": int(cpus), "runs": runs,
           "spark": spark.version}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
