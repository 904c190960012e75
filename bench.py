"""Warm seconds of the headline queries on one machine; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from voxelgrid import catalog

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["block_average", "block_average_multi", "sliding_z_average", "halo_tile", "halo_group", "halo_group2d", "window_block", "stencil_mean_group", "tile_roundtrip", "io_theory"]


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    found = {}
    for name in HEADLINE:
        query = catalog.queries()[name]
        for _ in range(2):  # the first run warms up
            began = time.perf_counter()
            query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
            found[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "total_warm_seconds", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": SF_DIR.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
