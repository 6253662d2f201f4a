"""Times the headline queries; prints one line of JSON.

BENCH_SF_DIR names the tables' folder, BENCH_CPUS the cores, BENCH_QUERIES a list
of queries in place of the headline ones, BENCH_RUNS how often each runs (the best
counts, after one run to warm up).
"""
from __future__ import annotations

import json
import os
import sys
import time

from scanloom.plans.queries import QUERIES
from scanloom.session import local_session

HEADLINE = ["code_findings", "pattern_findings", "python_line_findings", "javascript_findings", "go_findings",
            "fact_findings", "generic_findings_documents", "generic_findings_pages", "go_findings_documents",
            "severity_counts", "top_findings_per_language", "vulnerable_dependencies", "patch_results",
            "patched_files", "hourly_severity_counts"]


def run(spark, name: str, folder: str) -> float:
    """Seconds to compute every row and column of a query."""
    start = time.time()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.time() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ["BENCH_QUERIES"].split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(cpus)
    seconds = {}
    for name in names:
        run(spark, name, folder)
        seconds[name] = round(min(run(spark, name, folder) for _ in range(runs)), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": float(scale) if scale.replace(".", "").isdigit() else scale}))


if __name__ == "__main__":
    main()
