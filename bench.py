"""Seconds of the headline queries on the tables in $BENCH_SF_DIR, as one JSON line; each is the median of two runs after one to warm up."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from tessella.plans.queries import QUERIES

HEADLINE = ("label_summary", "rois_in_viewport", "rois_for_slide_page", "export_rois", "measurements_comparable", "measurement_latest", "recent_interactions", "catalog_files", "catalog_stats_projects", "provenance_chain", "doctor_dangling", "dedupe_plan", "slide_upsert", "roi_overlaps", "heatmap_grid")


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            began = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs[1:]), 4)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, sum of medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
