"""Time the headline jobs: one JSON line with warm seconds per job."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from plumbline.plans import catalogue  # noqa: E402

HEADLINE = [
    "pixel_grid",
    "frame_points",
    "cloud_per_frame_floor",
    "voxel_grid",
    "ground_plane",
    "horizontal_levels",
    "object_heights",
    "coverage_audit",
    "view_raster",
    "trial_statistics",
    "uncertainty_budget",
    "scale_trajectory",
    "replay_study",
    "manifests",
    "desired_keys",
    "run_phases",
]


def main() -> None:
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("plumbline-bench")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        job = catalogue.PLANS[name].job
        for _ in range(2):
            start = time.perf_counter()
            job(spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline jobs, warm, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
