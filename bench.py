"""Benchmark: headline lifecycle queries on one scale factor.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default the headline set). Prints one JSON line.

The stand-in domain tables are derived from the driver tables in a fresh folder (timed
cold as ``build_tables``, part of the total), then every query runs over them and is forced
with a ``noop`` write, so the time covers the whole plan without collecting to the driver.
A query runs up to BENCH_RUNS times (default 5) while it has used under BENCH_SECONDS
(default 8); its time is the median, and ``runs`` says of how many.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "status_summary", "state_counts", "unpaid_declarations", "stale_unlocked_receipts",
    "retention_expired", "exclude_locked", "acquire_locks", "encode_references",
    "validate_references", "assign_references", "accept_submissions", "payment_outcomes",
    "apply_payments", "receipt_parameters", "goods_items", "previous_declaration_view",
    "previous_declaration_lookup", "submission_batch", "requeue_failed", "stream_payments",
    "stream_status",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE

    from passlane.plans.inputs import Inputs
    from passlane.plans.queries import queries
    from passlane.session import build_session

    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(8, cpus * 2),
                          app_name="passlane-bench")
    qs = queries()
    t0 = time.time()
    Inputs(spark, sf_dir).build_all()
    timings = {"build_tables": round(time.time() - t0, 3)}
    most, seconds = int(os.environ.get("BENCH_RUNS", "5")), float(os.environ.get("BENCH_SECONDS", "8"))
    runs = {}
    for name in names:
        took: list[float] = []
        while len(took) < most and (not took or sum(took) < seconds):
            t0 = time.time()
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.time() - t0)
        timings[name], runs[name] = round(statistics.median(took), 3), len(took)
    total = round(sum(timings.values()), 3)
    sf = os.path.basename(sf_dir).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec",
                      "queries": timings, "runs": runs, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
