"""Headline queries, timed: prints one JSON line.

``BENCH_SF_DIR`` names the tables (default: sf0.1), ``BENCH_CPUS`` the number of local cores.
A time covers building the plan and running it to the end, without collecting the rows; ``plan`` is the
part of it that the driver takes to build the plan. One untimed scan runs first, so that no query pays
for the start of the JVM's compiler and of the Python workers.
"""

from __future__ import annotations

import json
import os
import sys
import time

from vetgrid.session import builder
from workload.queries import QUERIES

HEADLINES = (
    "scan_by_category", "scan_full", "directory_scan", "custom_rules_raw", "changed_files",
    "incremental_scan", "upsert_findings", "verify_fixes", "apply_updates", "update_audit",
    "summary", "trend_totals", "open_running", "top_files", "findings_with_audit",
    "status_history", "config_findings", "project_types", "file_outline", "boundary_crossings",
    "dependency_findings", "triage_verdicts", "review_requests", "sarif_results", "report_lines",
    "stream_counts",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        builder("bench").master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["scan_by_category"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times, plans = {}, {}
    for name in sys.argv[1:] or HEADLINES:
        begin = time.perf_counter()
        result = QUERIES[name](spark, sf_dir)
        plans[name] = round(time.perf_counter() - begin, 3)
        result.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
        print(name, times[name], plans[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "plan": plans, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
