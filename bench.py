"""Times the headline queries and prints one JSON line: BENCH_SF_DIR (data), BENCH_CPUS (local cores), BENCH_RUNS (warm runs)."""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

HEADLINE = [
    "seed_intervals", "alignment_segment_hash", "interval_overlap_join", "interval_union_padded", "coverage_raw", "read_adjacent_pairs", "read_gap_pairs",
    "breakpoint_clusters", "breakpoint_exact_call", "graph_stats", "concordant_support", "shared_read_segments", "path_support", "cycle_to_bed", "fragment_similarity", "hsr_sites",
]


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from pyspark.sql import SparkSession

    from helixmill import catalog

    data, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = catalog.queries(), {}
    for name in HEADLINE:
        each = []
        for _ in range(1 + runs):  # the first run compiles the plan's code
            began = time.perf_counter()
            queries[name](spark, data).write.format("noop").mode("overwrite").save()
            each.append(time.perf_counter() - began)
        took[name] = round(median(each[1:]), 3)
    print(json.dumps({"metric": "total warm seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(data.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
