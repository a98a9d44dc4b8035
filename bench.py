"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the cores. Each query runs
once to warm up and then three times; the median counts. Results are written to Spark's `noop`
sink, so every row and column is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from riskloom.checks import all_queries
from riskloom.session import local_session

HEADLINE = (
    "rule_matches", "secrets", "dedup_scanner", "marked_context", "component_rollup", "fixed_files", "profiles",
    "findings_with_validation", "report_titles", "finding_numbers", "merged_ranges", "routed_files", "code_metrics",
    "data_flows", "validation_prompts", "agent_findings", "daily_trend",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session("bench", os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8)))
    names = sys.argv[1:] or HEADLINE
    queries, seconds = all_queries(), {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            started = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf.rstrip("/")), "cpus": spark.sparkContext.defaultParallelism}))
    spark.stop()


if __name__ == "__main__":
    main()
