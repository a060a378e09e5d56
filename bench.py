"""Times the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the threads. Every query runs
twice and the second time counts, so that the start of the JVM and of the
Python workers is left out. The three read paths run on copies of the tables'
telemetry that follow each other in time.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airsleuth.catalog import QUERIES
from airsleuth.catalog.base import detections, features, wide
from airsleuth.detectors.base import RuleDetector
from airsleuth.detectors.scores import MixtureDetector
from airsleuth.operators.evaluation import alert_bursts, detection_report, label_detections
from airsleuth.operators.features import build_features_from_wide
from airsleuth.operators.rules import rule_events
from airsleuth.operators.serving import daily_view, detection_page, detection_statistics, event_view
from airsleuth.plans.detection import detect
from airsleuth.schema import RAW_TIME
from airsleuth.session import free_scratch, local_session
from airsleuth.sources.cache import features_of_files, read_cache, write_cache
from airsleuth.sources.csv import find_files, write_files

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: Zone rows of the read paths, whose published rates are of 54 million; copies of a year follow each other.
READ_ROWS = int(os.environ.get("BENCH_READ_ROWS", "5000000"))


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = tempfile.mkdtemp(prefix="bench-")
    spark: SparkSession = local_session(CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    raw, csv, cache, all_cached = (f"{folder}/{name}" for name in ("raw", "csv", "cache", "all"))
    write_cache(features(spark, SF_DIR), cache, as_floats=False)
    copies = -(-READ_ROWS // spark.read.parquet(cache).count())
    year = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    many = wide(spark, SF_DIR).withColumn("_year", year).withColumn(
        RAW_TIME, F.col(RAW_TIME) + F.make_dt_interval(F.col("_year") * 366)).drop("_year")
    many.repartition(int(CPUS)).write.parquet(raw)
    write_files(spark.read.parquet(raw), csv)
    write_cache(build_features_from_wide(spark.read.parquet(raw)), all_cached)
    rows = spark.read.parquet(all_cached).count()

    def cached() -> DataFrame:
        return spark.read.parquet(cache)

    def gaussian_ensemble() -> DataFrame:
        gaussian = MixtureDetector(components=1, covariance="diag").fit(cached())
        return detect(cached(), [RuleDetector(), gaussian])

    runs = {
        "csv_to_features": lambda: features_of_files(spark, find_files(spark, csv)),
        "raw_to_features": lambda: build_features_from_wide(spark.read.parquet(raw)),
        "projected_read": lambda: read_cache(spark, all_cached),
        "cache_to_rule_events": lambda: rule_events(cached()),
        "rules_from_events": lambda: QUERIES["r6_rule_events"](spark, SF_DIR),
        "ensemble": gaussian_ensemble,
        "detection_report": lambda: detection_report(label_detections(cached(), rule_events(cached()))),
        "alert_bursts": lambda: alert_bursts(rule_events(cached()).withColumn("row_seq", F.lit(0)), 600),
        "daily_cube": lambda: daily_view(event_view(detections(spark, SF_DIR))),
        "statistics": lambda: detection_statistics(detections(spark, SF_DIR)),
        "page": lambda: detection_page(detections(spark, SF_DIR)),
    }
    seconds = {}
    for name, build in runs.items():
        for _ in range(2):
            start = time.perf_counter()
            drain(build())
            seconds[name] = round(time.perf_counter() - start, 3)
    rates = {n: round(rows / seconds[n]) for n in ("csv_to_features", "raw_to_features", "projected_read")}
    free_scratch(spark)
    spark.stop()
    shutil.rmtree(folder)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "read_zone_rows": rows, "zone_rows_per_sec": rates,
    }))


if __name__ == "__main__":
    main()
