"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the cores.
Every query runs once to warm up and then BENCH_RUNS times; the median counts.  All
rows are produced and thrown away, so that nothing but the query is timed.
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import QUERIES  # noqa: E402
from vectormart.session import make_session  # noqa: E402

HEADLINE = (
    "most_alike", "audio_mart", "feature_stats", "dedup_copies", "dedup_latest", "vector_z", "frozen_zscore",
    "flatten_features", "staging_cast", "track_document", "coverage_profile", "null_profile", "feature_quantiles",
    "lenient_key", "list_to_csv", "match_report", "select_files", "resume_pending", "lookup_pending",
    "attach_artwork", "cache_stats", "knn_one", "knn_by_id", "similar_tracks", "eval_neighbors",
    "diversified_retrieve", "rag_context", "answer_cards", "collection_upsert", "slice_rest", "write_parts",
)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = make_session("bench", f"local[{cpus}]", {
        "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false",
        # Derived tables are small here; without this all their work would fall to one core.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k"})
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        if name not in QUERIES:
            continue
        times = []
        for _ in range(runs + 1):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(times[1:] or times), 4)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "sum of median seconds of the headline queries", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
    }))


if __name__ == "__main__":
    main()
