"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the local cores; BENCH_QUERIES a comma-separated
subset. Every query runs in full, from the tables to its last output row. Each runs once before on
the smallest tables beside them, untimed: a session's first use of a plan compiles code and forks
workers, which is no part of a warm run.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from workload import catalog  # noqa: E402

HEADLINE = [
    "rating_fold", "final_ratings", "flat_replay_delta", "top20", "global_rank", "daily_snapshot", "recent_form",
    "peak_low", "rating_history", "dedup_anti", "merge_matches", "chrono_sort", "registry", "team_record",
    "season_breaks", "league_avg", "spearman", "before_after", "src_csv", "match_id", "src_api_json", "sink_matches",
    "elo_update", "team_match_long",
    "fold_sliced",
]


def run(spark: SparkSession, name: str, sf_dir: str) -> None:
    catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    width = 8 if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("ladderline-bench")
        .config("spark.sql.shuffle.partitions", str(width))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    for name in names:
        run(spark, name, small if os.path.isdir(small) else sf_dir)
    seconds = {}
    for name in names:
        start = time.perf_counter()
        run(spark, name, sf_dir)
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
