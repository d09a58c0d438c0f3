"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all cores),
BENCH_QUERIES (comma-separated names), BENCH_RUNS (timed runs per query after a warm-up, median; default 1).
"""

from __future__ import annotations

import importlib
import json
import os
import statistics
import sys
import time

from patchlake.session import local_session

HEADLINE = (
    "curate_commits curate_filter_files tag_counts corpus_stats resume_anti_join upsert_partial point_ids "
    "literal_search literal_indexed tokens_positions fts_match fts_cover_rank dense_topk lsh_knn cells_knn bm25_weights bm25_search rrf_fuse dbsf_fuse "
    "hybrid_search dense_bm25_search indexed_search batch_search_deep commit_lookup ir_metrics latency_p50 pool_judgments "
    "embed_hash index_build stream_upsert run_all "
    "op1_bpe op2_ngram_join op3_url_filter op4_winnowing op5_best_fit_packing op6_hash_forest op7_language_id "
    "op8_rans_token_files op9_suffix_dedup op10_label_shards op11_wrapper_text op12_merkle_manifest op13_shared_search pipeline"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS") or str(os.cpu_count())
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(cores, shuffle_partitions=2 * int(cores))
    queries = importlib.import_module("__spark_entry__").queries()
    names = [name for name in names if name in queries]
    times: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):  # the first run warms up
            started = time.time()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.time() - started)
        times[name] = round(statistics.median(taken[1:]), 3)
        print(f"{name}: {times[name]}s (first {taken[0]:.1f}s)", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
