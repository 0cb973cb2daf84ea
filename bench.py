"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores.  Every query is run to its full result
(noop sink), once to warm up and then BENCH_RUNS times; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from foliomill.plans.catalog import QUERIES
from foliomill.session import local_session

HEADLINE = (
    "extract_dates", "extract_amounts", "token_counts", "bm25_topk", "bm25_in_document", "classify_docs",
    "extract_invoices", "rules_contract", "rules_invoice", "rules_report", "rules_invoice_lines", "duplicate_items",
    "gate_rules", "gate_overall", "rule_tally", "analysis_counts", "state_latest", "rollback_jobs", "trace_totals",
    "pct_change", "decision_guard", "review_outcome", "review_status", "batch_infer",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", " ".join(HEADLINE)).split()
    spark = local_session("bench", cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    seconds = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:] or times), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
