"""Seconds per headline query, as one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Every query is run to its end
into a sink that drops the rows; one untimed pass over the small tables warms the JVM.
"""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from airsense.plans.queries import QUERIES, flagship  # noqa: E402

HEADLINE = (
    "validation_counts", "missing_profile", "numeric_profile", "duplicate_groups", "dedupe_first",
    "preprocess", "features_rolling", "feature_frame", "live_normalise", "upsert_last_wins",
    "score_summary", "overview", "recent_alerts", "station_summary", "timeline",
    "cooccurrence_gap", "monitoring_report", "time_split", "threshold_tuning",
    "multilabel_metrics", "preprocessor_stats", "pollutant_quartiles", "season_hour_pivot",
)


def run(spark: SparkSession, query, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or [*HEADLINE, "flagship"]
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("airsense-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_CHECKPOINTS", "/tmp/checkpoints/bench"))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = QUERIES | {"flagship": flagship}
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        for name in names:
            run(spark, queries[name], small)
    seconds = {name: round(run(spark, queries[name], sf_dir), 3) for name in names}
    print(
        json.dumps(
            {
                "metric": "headline query time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
