"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from urbanflow.queries import QUERIES

HEADLINE = [
    "grid_nse_flooding", "t4_interpolate", "t6_align_by_shape", "m13_ks_2samp", "g2_to_utm", "g8_segmentize", "j1_with_endpoints",
    "j3_nodes_to_subs", "j7_pairs_within", "n2_remove_parallel_edges", "n4_street_cover", "n11_filter_streets", "w3_chahinian_slope",
    "w5_calculate_weights", "r3_d8", "r4_cell_slope", "r14_derive_rc", "d4_select_design", "c3_edit_distance", "p5_accumulate_forest",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES[HEADLINE[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up isn't counted
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
