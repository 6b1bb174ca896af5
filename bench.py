"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the folder of the test tables, ``BENCH_CPUS`` the
local threads. ``BENCH_SCALE_TIMES`` (0: left out) stores the fact table that
many times over and projects it once, to see how work grows with rows. Times are medians of warm runs into a sink that discards rows,
from building the frame to the last row. ``calibration`` is a fixed piece of work that reads no table and calls nothing of this
repository, taken before and after the queries: between rounds it changes with the machine, not with the code.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from fiscus import project_revenue  # noqa: E402
from fiscus.operators.aggregate import reduce_fact  # noqa: E402
from fiscus.plans.catalogue import CATALOGUE  # noqa: E402
from fiscus.schema import Horizon  # noqa: E402
from fiscus.shared import new_folder  # noqa: E402
from fiscus.sources.fact import read_fact_parquet  # noqa: E402
from testbed.lineitem_fact import fact_from_lineitem  # noqa: E402
from testbed.queries import all_slices_one_by_one, queries  # noqa: E402

HEADLINE = [
    "revenue_projection",
    "all_slices_single_pass",
    "slice_c04",
    "stacked_c03",
    "net_aggregate",
    "flag_audit_counts",
    "publish_parquet_readback",
]
WARM_RUNS = 3


def seconds(run) -> float:
    start = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def median_of_warm_runs(run, runs: int = WARM_RUNS) -> float:
    seconds(run)
    return round(statistics.median(seconds(run) for _ in range(runs)), 3)


def calibration(spark: SparkSession) -> float:
    """Seconds of a fixed grouping of numbers."""
    return median_of_warm_runs(
        lambda: spark.range(20_000_000).groupBy((F.xxhash64("id") % 1000).alias("key")).agg(F.sum(F.sqrt("id")).alias("total"))
    )


def scans(frame) -> int:
    """Scans of files in the plan of a frame."""
    return frame._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")


def scale_check(spark: SparkSession, sf_dir: str, times: int) -> dict:
    """Seconds of one projection over the stored fact taken ``times`` times, and rows through its first shuffle."""
    folder = new_folder(spark, "bench-scale")
    fact = fact_from_lineitem(spark, sf_dir).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))
    fact.drop("copy").write.partitionBy("num_ano").parquet(folder)
    large = read_fact_parquet(spark, folder)
    return {
        "times": times,
        "fact_rows": large.count(),
        "projection_seconds": round(seconds(lambda: project_revenue(large)), 3),
        "reduced_rows": reduce_fact(large, CATALOGUE, Horizon()).count(),
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("fiscus-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    registered = queries()
    before = calibration(spark)
    times = {
        name: median_of_warm_runs(lambda name=name: registered[name](spark, sf_dir)) for name in HEADLINE
    }

    stored = new_folder(spark, "bench-fact")
    fact_from_lineitem(spark, sf_dir).repartition(int(cpus)).write.partitionBy("num_ano").parquet(stored)
    times["revenue_projection_stored_fact"] = median_of_warm_runs(
        lambda: project_revenue(read_fact_parquet(spark, stored))
    )
    one_by_one = round(seconds(lambda: all_slices_one_by_one(spark, sf_dir)), 3)

    times_over = int(os.environ.get("BENCH_SCALE_TIMES", "0"))
    scale = {"scale": scale_check(spark, sf_dir, times_over)} if times_over else {}

    print(
        json.dumps(
            {
                "metric": "sum of median warm seconds over the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "calibration": {"before": before, "after": calibration(spark)},
                "for_comparison": {
                    "all_slices_one_by_one": one_by_one,
                    "scans": {
                        "all_slices_single_pass": scans(registered["all_slices_single_pass"](spark, sf_dir)),
                        "all_slices_one_by_one": scans(all_slices_one_by_one(spark, sf_dir)),
                    },
                },
            }
            | scale
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
