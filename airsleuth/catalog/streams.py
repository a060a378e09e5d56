"""Streaming queries: each drains what is there and returns what the sink holds."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airsleuth.catalog.base import DETECTIONS, HITS, detections, long, micros, query, wide, with_sql
from airsleuth.catalog.events import HIT_SQL, shown
from airsleuth.operators.reshape import normalize
from airsleuth.schema import RAW_TIME
from airsleuth.session import scratch_path
from airsleuth.streaming.streams import RuleStream, burst_sessions, daily_counts, distinct_events, drain, drain_whole

#: Raw rows to a file of a quarter.
FILE_ROWS = 50_000


def _arriving(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """A stream over a folder that holds the rows already."""
    folder = scratch_path(spark, "arriving")
    rows.write.parquet(folder)
    return spark.readStream.schema(rows.schema).parquet(folder)


def _quarters(rows: DataFrame, folder: str) -> Iterator[None]:
    """Normalized rows of the quarters of a year, written to ``folder`` one quarter a step; its files are in no order.

    Raw rows are dealt out, a fifth of the normalized ones; the more there are, the more files.
    """
    quarter = F.quarter(RAW_TIME)
    sizes = dict(rows.groupBy(quarter.alias("quarter")).count().collect())
    for number in range(1, 5):
        files = max(4, math.ceil(sizes.get(number, 0) / FILE_ROWS))
        normalize(rows.filter(quarter == number).repartition(files)).write.mode("append").parquet(folder)
        yield


def _arriving_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detections(spark, sf_dir).select("id", "event_time", "zone_id", "equipment_id", "alert_level")
    return _arriving(spark, rows)


@query("x2_daily_counts", with_sql(DETECTIONS, f"""
SELECT epoch_us(date_trunc('day', event_time)) AS day_us, zone_id, alert_level, count(*) AS detection_count FROM detections
GROUP BY ALL"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All days, as the input has ended."""
    stream = daily_counts(_arriving_detections(spark, sf_dir), ["zone_id", "alert_level"])
    out = drain_whole(stream, spark, scratch_path(spark, "daily"))
    return out.select(micros("day_start").alias("day_us"), "zone_id", "alert_level", "detection_count")


@query("x3_burst_sessions", with_sql(DETECTIONS + f""",
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY zone_id, equipment_id ORDER BY event_time) AS burst FROM (
  SELECT *, CASE WHEN epoch_us(event_time) - epoch_us(lag(event_time) OVER (PARTITION BY zone_id, equipment_id ORDER BY event_time)) <= 36000000000
    THEN 0 ELSE 1 END AS starts FROM detections))""", f"""
SELECT zone_id, equipment_id, epoch_us(min(event_time)) AS start_us, epoch_us(max(event_time)) AS end_us, count(*) AS rows
FROM numbered GROUP BY zone_id, equipment_id, burst"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sessions with gaps of up to ten hours, as the input has ended."""
    stream = burst_sessions(_arriving_detections(spark, sf_dir), "10 hours", keys=["zone_id", "equipment_id"])
    out = drain_whole(stream, spark, scratch_path(spark, "bursts"))
    return out.select("zone_id", "equipment_id", micros("burst_start").alias("start_us"), micros("burst_end").alias("end_us"), "rows")


@query("x4_distinct_events", with_sql(DETECTIONS, """
SELECT DISTINCT epoch_us(date_trunc('hour', event_time)) AS hour_us, zone_id FROM detections"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times are cut to hours, so keys repeat."""
    rows = detections(spark, sf_dir).select(F.date_trunc("hour", "event_time").alias("event_time"), "zone_id")
    stream = distinct_events(_arriving(spark, rows), keys=["event_time", "zone_id"])
    return drain(stream, spark, scratch_path(spark, "distinct")).select(micros("event_time").alias("hour_us"), "zone_id")


@query("x1_rule_stream", with_sql(HITS, f"SELECT {HIT_SQL} FROM rule_events"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows arrive in four batches; the events equal those of one batch."""
    folder, arriving = scratch_path(spark, "rules"), scratch_path(spark, "arriving")
    rules = RuleStream(spark, folder)
    kind = long(spark, sf_dir).schema
    for _ in _quarters(wide(spark, sf_dir), arriving):
        # Each run takes all that has come since the run before, in one batch.
        source = spark.readStream.schema(kind).parquet(arriving)
        rules.writer(source, f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return shown(rules.events())
