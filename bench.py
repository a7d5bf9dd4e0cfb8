"""Time the headline queries, warm, and print one JSON line.

BENCH_SF_DIR is the folder of the tables, BENCH_CPUS the number of local cores,
BENCH_RUNS the timed runs per query (the median counts), BENCH_QUERIES an optional
comma-separated choice of queries.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from catalog.queries import QUERIES

HEADLINES = (
    "validate_report", "validate_lineitem", "clean_then_validate", "null_severity",
    "pseudo_null_counts", "full_duplicates", "id_duplicates", "id_maps_to_many_categories",
    "iqr_outliers", "total_mismatch", "case_variants", "category_columns", "id_length_histogram",
    "best_date_format", "date_range", "infer_types", "fix_fill_median", "fix_fill_mode",
    "fix_drop_full_duplicates", "fix_drop_col_duplicates", "fix_cap_outliers_iqr",
    "fix_cast_to_datetime", "fix_audit",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    chosen = os.environ.get("BENCH_QUERIES")
    names = tuple(chosen.split(",")) if chosen else HEADLINES
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({
        "metric": "headline_queries_total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
