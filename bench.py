"""Headline queries, warm, one JSON line.

Settings: BENCH_SF_DIR, BENCH_CPUS, BENCH_RUNS (median of that many warm runs),
BENCH_QUERIES (comma-separated names, or 'all' for the whole catalog).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from srcloom.plans.catalog import CATALOG  # noqa: E402
from srcloom.session import build_session  # noqa: E402

HEADLINE = (
    "extract_functions", "make_chunks", "chunk_stats", "budget_filter", "block_split", "hybrid_split",
    "overlap_window", "chunk_context", "strip_comments", "token_estimate", "content_hash", "line_count",
    "validate_responses", "assemble_results", "functions_table", "metrics_long", "file_summary", "run_stats",
    "file_document", "resolve_calls", "assign_models", "rate_slots", "dedup_chunks", "snapshot_diff",
    "cache_latest", "attempt_summary", "retry_queue", "vector_topk", "vector_search", "stream_append",
    "stream_dedup",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(CATALOG) if chosen == "all" else chosen.split(",") if chosen else list(HEADLINE)
    spark = build_session(
        f"local[{cpus}]",
        "bench",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            CATALOG[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(taken[1:]), 3)
        print(name, timings[name], file=sys.stderr, flush=True)
    total = round(sum(timings.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total_seconds",
                "value": total,
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
