"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the local cores.  Each query runs
once to warm up and once timed, through the no-op sink, so every row is produced.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from gridweave.catalog import queries

HEADLINE = (
    "boxes",
    "neighbor_pairs",
    "interaction_pairs",
    "block_census",
    "leaf_membership",
    "constraint_violations",
    "distance_join",
    "kernel_entries",
    "matvec",
    "rmatvec",
    "matvec_thick",
    "leaf_blocks",
    "spectral_norm",
    "column_bases",
    "hier_matvec",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("gridweave-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = queries()
    times = {}
    for name in HEADLINE:
        for timed in (False, True):
            start = time.perf_counter()
            found[name](spark, folder).write.format("noop").mode("overwrite").save()
            if timed:
                times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
