"""Wall time of the headline queries: one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from gridloom.plans import catalogue

HEADLINE = [
    "g12_keys_per_cell_numa", "g06_rect_cells", "g10_cooccurrence", "k01_upsert_latest", "k03_lookup", "k04_scan_many", "k08_lower_bound",
    "r11_contains_count", "r11b_overlap_count", "r14_knn", "q01_intersects_count",
    "p04_data_view", "p06_cumulative", "p15_op_latency", "w08_fnv64", "x01_mixed_ops",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/orders.parquet").count()  # start-up is not part of a query
    times = {}
    for name in HEADLINE:
        began = time.perf_counter()
        catalogue.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf)}))
    spark.stop()


if __name__ == "__main__":
    main()
