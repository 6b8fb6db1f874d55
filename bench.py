"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query is timed once, cold, from building the frame to a full evaluation
(``noop`` sink, so every row and column is computed). Stored inputs and the two
stage tables are timed as queries of their own: ``build_<input>`` derives an input
from the raw tables, ``build_silver`` writes silver, ``build_gold`` reads silver,
marks duplicates and writes gold. Later queries read those tables, as they would
in production.
"""

from __future__ import annotations

import json
import os
import time

from docpipe.session import local_session
from workload import inputs
from workload.queries import QUERIES

HEADLINE = [
    "silver_documents", "quality_flags", "outcome_routing", "candidate_extract", "evidence_silver", "enrichment_merge",
    "enriched_silver", "response_parse", "best_attempt", "arrival_unwrap", "text_clean_lines", "text_fingerprint",
    "gold_documents", "gold_incremental", "gold_run", "idempotent_skip", "batch_completeness", "batch_manifest",
    "run_summary", "acceptance_gate", "flag_counts", "latency_percentiles", "latency_by_run", "collision_names",
    "contract_report", "q_total_by_supplier", "q_top_suppliers", "q_vendor_spend",
    "q_latest_batch_per_vendor", "q_docs_per_vendor", "sql_surface_joins", "status_latest", "status_forward",
    "dead_letter", "alarm_windows", "stream_ingest", "stream_gold", "stream_status",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors

    seconds: dict[str, float] = {}

    def timed(name: str, work) -> None:
        start = time.perf_counter()
        work()
        seconds[name] = round(time.perf_counter() - start, 3)

    for name, make in inputs.STORED.items():
        timed(f"build_{name}", lambda: make(spark, sf_dir))
    timed("build_silver", lambda: inputs.silver_table(spark, sf_dir))
    timed("build_gold", lambda: inputs.gold(spark, sf_dir))
    for name in HEADLINE:
        timed(name, lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
