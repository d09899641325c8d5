"""Seconds per headline query; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma
separated names, or "all").
"""

from __future__ import annotations

import json
import os
import sys
import time

from fieldlake.plans.catalog import QUERIES
from fieldlake.session import local_session

HEADLINE = [
    "q_quality_report", "q_html_clean", "q_validate_props", "q_exact_dedup", "q_near_dedup", "q_lang_detect",
    "q_alias_resolve", "q_alias_extract", "q_category", "q_standardize", "q_standardize_markets", "q_missingness",
    "q_length_stats", "q_histogram", "q_balance", "q_gaps", "q_synth_crop", "q_synth_market", "q_synth_grid",
    "q_review_queue", "q_index_stats", "q_bm25", "q_tfidf", "q_hash_embed", "q_dense_topk", "q_rrf", "q_query_plan",
    "q_graph_edges", "q_neighbors", "q_ecosystem", "q_price_summary", "q_pest", "q_audit", "q_farm_upsert",
    "q_ingest_plan", "q_stream_alerts", "q_stream_windows", "q_quality_run", "q_multi_query", "q_dense_search", "q_two_hop", "q_lake_flow",
    "q_profile_merge", "q_ingest_revert", "q_stream_upsert", "q_stream_ttl", "q_standardize_crops",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    spark = local_session("bench", cpus)
    QUERIES["q_quality_report"](spark, sf_dir).count()  # start the JVM and the Python workers
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total query time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
