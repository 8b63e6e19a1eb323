"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [repeats]
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewatch.session import build_session  # noqa: E402

HEADLINE = [
    "severity_top_all", "economic_summary", "country_totals", "type_comparison", "correlations", "clean_quakes",
    "reduce_storms", "top_days", "decluster", "month_matrix", "quake_seasonality", "quake_exposure", "storm_exposure",
    "storm_zones", "month_features", "month_labels", "build_panel", "model_metrics", "average_ranks", "smart_matches",
    "task_state", "exact_name_matches", "normalise_gdacs", "stream_daily_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    from tidewatch.catalog import QUERIES, load_all

    load_all()
    QUERIES["hero_stats"](spark, sf_dir).collect()  # warms up the JVM
    repeats = int(sys.argv[1]) if len(sys.argv) > 1 else 1
    times = {}
    for name in HEADLINE:
        best = None
        for _ in range(repeats):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1].strip("/")}))


if __name__ == "__main__":
    main()
