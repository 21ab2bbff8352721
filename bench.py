"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all cores),
BENCH_LIMIT (seconds a query may take, default 240). A query that fails or goes
beyond the limit is listed under "failed" and the others are still timed; a run
that is ended from outside prints what it has.
Arguments name queries to time instead; "all" times every registered one.
"""

from __future__ import annotations

import json
import os
import signal
import sys
import threading
import time

from repohealth.plans import REGISTRY
from repohealth.session import build_session

HEADLINE = (
    "scored_trend", "overall_score", "severity_counts", "file_health", "deduction_score", "reconcile", "diff_new",
    "module_deltas", "score_delta", "match_rules", "secrets", "phi_rules", "external_silos", "imports",
    "resolve_imports", "dead_exports", "repo_traits", "bus_factor", "churn", "similarity", "agreement",
    "vulnerable_deps", "outdated_deps", "lcov", "diagnostics", "action_bundles", "budget_pack", "sample_files",
    "blast_radius", "short_cycles", "communities", "latest_progress",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    limit = float(os.environ.get("BENCH_LIMIT", "240"))
    names = sys.argv[1:] or list(HEADLINE)
    if names == ["all"]:
        names = list(REGISTRY)
    spark = build_session(
        "repohealth-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    # The first query of a session pays for class loading; it is not part of any query's time.
    REGISTRY["severity_counts"](spark, folder).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    failed: dict[str, str] = {}

    def report(*_) -> None:
        print(json.dumps({
            "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
            "queries": times, "failed": failed, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        }), flush=True)

    def ended(*_) -> None:
        report()
        os._exit(1)

    signal.signal(signal.SIGTERM, ended)
    for name in names:
        over = threading.Event()

        def stop(over=over) -> None:
            # a loop may just be between two jobs, so its jobs are cancelled until it gives up
            while not over.wait(0.5):
                spark.sparkContext.cancelAllJobs()

        timer = threading.Timer(limit, stop)
        timer.daemon = True
        timer.start()
        start = time.perf_counter()
        try:
            REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        except Exception as exc:  # report it and time the others
            failed[name] = f"{time.perf_counter() - start:.0f} s: {type(exc).__name__}"
        finally:
            over.set()
            timer.cancel()
        print(f"{name} {times.get(name, failed.get(name))}", file=sys.stderr, flush=True)
    report()
    spark.stop()


if __name__ == "__main__":
    main()
