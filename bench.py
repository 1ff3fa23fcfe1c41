"""Times the headline queries and prints one JSON line.

Each query's result is written to nowhere, after one unmeasured round that reads the files and
compiles the code; the figure is the best of two rounds.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tianguis.plans.queries import QUERIES

HEADLINE = [
    "price_summary_by_currency", "mad_outliers", "unit_price_summary", "province_source_breakdown", "max_gap_by_province", "seller_concentration", "supply_level",
    "weekly_median_series", "coverage_stable_supply", "classify_price_series", "asof_rate", "freshness_sources", "strong_dedup_components", "match_levels", "url_normalise", "history_latest_snapshot",
]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(name):
        began = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.time() - began

    took = {}
    for name in HEADLINE:
        once(name)
        took[name] = round(min(once(name), once(name)), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
