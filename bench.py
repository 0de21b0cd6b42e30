"""Benchmark: headline queries, one warm-up run and the median of the timed runs, as one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the local cores, ``BENCH_RUNS`` the timed runs and
``BENCH_QUERIES`` a comma-separated choice (``all`` for every registered query).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "vector_topk", "vector_topk_per_type", "extract_keywords", "text_relevance", "frame_caption_search", "video_timeline",
    "hybrid_search", "hybrid_retrieval", "diversity_top3", "competition_rank", "related_entities_all", "co_occurrence",
    "entity_group_merge", "entity_fold_merge", "relation_group_merge", "graph_stats", "connected_components", "neighborhood_2hop",
    "graph_cleanup", "extraction_parse", "cytoscape_export", "recent_context", "frame_sampling", "worker_liveness", "cluster_status",
    "upsert_latest",
)


def main() -> None:
    from reelgraph.session import build_session
    from reelgraph.workload import load_all

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    registry = load_all()
    choice = os.environ.get("BENCH_QUERIES", "")
    names = list(registry) if choice == "all" else [n for n in choice.split(",") if n] or list(HEADLINE)
    spark = build_session("bench", cpus)
    taken: dict[str, float] = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            registry[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        taken[name] = round(statistics.median(times[1:]), 3)
        print(f"{name} {taken[name]}", file=sys.stderr, flush=True)
    total = round(sum(taken.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": taken, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
