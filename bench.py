"""Seconds per query, as one JSON line. Settings: BENCH_SF_DIR, BENCH_CPUS, BENCH_RUNS, BENCH_QUERIES, BENCH_SECONDS.

Each query runs once to warm up. It is then measured up to BENCH_RUNS times, but not again once it has taken `ENOUGH`
seconds; when BENCH_SECONDS have passed in all, the remaining queries are measured by their first run.
"""

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sluice import checks  # noqa: E402
from sluice.session import local_session  # noqa: E402


ENOUGH = 6


def seconds(spark, query, sf_dir):
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    limit = float(os.environ.get("BENCH_SECONDS", "1000"))
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else \
        list(checks.QUERIES)
    with tempfile.TemporaryDirectory(prefix="bench-") as shared:
        spark = local_session(cpus, cpus, "bench", spark__driver__memory="8g",
                              spark__checkpoint__dir=shared)
        spark.sparkContext.setLogLevel("ERROR")
        took, began = {}, time.perf_counter()
        for name in names:
            query = checks.QUERIES[name]
            first, each = seconds(spark, query, sf_dir), []
            while len(each) < runs and sum(each) < ENOUGH and time.perf_counter() - began < limit:
                each.append(seconds(spark, query, sf_dir))
            took[name] = round(statistics.median(each or [first]), 4)
        spark.stop()
    print(json.dumps({
        "metric": "total_median_query_seconds", "value": round(sum(took.values()), 4),
        "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus), "runs": runs}))


if __name__ == "__main__":
    main()
