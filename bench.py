"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is fully executed through the ``noop`` sink (no collect to the
driver). Building the stored tables is timed as lines of its own (``build_*``, part of the total). Prints one JSON line:
{"metric": "total_query_seconds", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "daily_metrics", "pr_cycles", "detection_audit", "detect_anomalies", "detect_backfill",
    "ingest_scan", "ingest_coverage", "upsert_replace", "upsert_partial", "slow_prs", "release_lookup",
    "enrichment_candidates", "artifact_text", "chunk_documents", "embed_chunks", "vector_search",
    "text_search", "hybrid_search", "evidence_bundle", "report_feed", "report_detail", "feed_cards",
    "eval_scores", "constraint_violations",
]

BUILDS = ["daily", "scored_checks", "artifacts", "chunk_store", "postings", "directory"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from vitals.plans.queries import REGISTRY
    from vitals.session import local_session
    spark = local_session(cpus=cpus, shuffle_partitions=int(cpus) * 2, app="vitals-bench")
    # warm-up: JVM, Python workers, Parquet footers
    REGISTRY["daily_metrics"][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    # the stored tables that searches and reports read, as lines of their own
    from vitals.sources.bindings import load
    for name in BUILDS if not sys.argv[1:] else []:
        t0 = time.perf_counter()
        load(spark, sf_dir, name)
        times[f"build_{name}"] = round(time.perf_counter() - t0, 3)
    for name in names:
        t0 = time.perf_counter()
        try:
            REGISTRY[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
        except Exception as e:  # noqa: BLE001 - keep measuring the others
            print(f"bench: {name} failed: {type(e).__name__}: {str(e)[:300]}", file=sys.stderr)
            times[name] = None
    m = re.search(r"sf([0-9.]+)", sf_dir)
    total = round(sum(v for v in times.values() if v is not None), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total,
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
