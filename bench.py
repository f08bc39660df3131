"""Time the queries over the star tables; prints one JSON line.

    BENCH_SF_DIR   folder of the star tables, default /root/testdata/sf0.1
    BENCH_CPUS     local cores, default all
    BENCH_QUERIES  comma-separated names, default all

Every query is planned, run to its last row and discarded, once, after a
warm-up query.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from salesaudit.catalogue.queries import QUERIES


def seconds(spark: SparkSession, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
    names = [name for name in os.environ.get("BENCH_QUERIES", "").split(",") if name] or list(QUERIES)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("salesaudit-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds(spark, "product_type_performance", folder)
    times = {name: seconds(spark, name, folder) for name in names}
    spark.stop()
    result = {
        "metric": f"{len(times)} sales audit queries, one run each, local[{cpus}]",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
