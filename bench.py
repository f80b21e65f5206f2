"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma-separated).
Every query runs twice; the second run counts. Results are computed in full and discarded.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "eligible_files", "language_counts", "token_counts", "line_windows", "fallback_chunks",
    "code_blocks", "context_headers", "code_chunks", "sparse_features", "index_stats",
    "search_sparse", "search_dense", "search_lsh", "overlap_dedup", "rag_sources", "prompts",
    "query_gate", "job_payloads", "repo_latest", "repo_list", "upsert_chunks", "delete_repo",
    "upsert_batches", "ingest_summary", "query_traces", "usage_by_model", "context_precision",
    "faithfulness", "answer_relevancy", "provider_compare",
]


def main() -> None:
    from sourceloom.session import local_session
    from suite.queries import REGISTRY

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
