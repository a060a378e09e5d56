"""Reads of stored events and jobs: filters, pages, statistics, daily cube, views."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airsleuth.functions.columns import or_unknown
from airsleuth.sources.store import DATE

# --- fixed values: page sizes ----------------------------------------------------
PAGE_DEFAULT, PAGE_MOST = 500, 1000
JOBS_DEFAULT = 20


@dataclass(frozen=True)
class DetectionFilter:
    """Conditions that must all hold; bounds are inclusive, None means any."""

    start: datetime | None = None
    end: datetime | None = None
    zone_id: str | None = None
    alert_level: str | None = None
    fault_type: str | None = None  # compared with predicted_fault


def filter_detections(events: DataFrame, by: DetectionFilter = DetectionFilter()) -> DataFrame:
    """Matching events. Time bounds also bound the partition column, so other days are not read."""
    dated = DATE in events.columns
    if by.start is not None:
        events = events.filter(F.col("event_time") >= F.lit(by.start))
        events = events.filter(F.col(DATE) >= F.to_date(F.lit(by.start))) if dated else events
    if by.end is not None:
        events = events.filter(F.col("event_time") <= F.lit(by.end))
        events = events.filter(F.col(DATE) <= F.to_date(F.lit(by.end))) if dated else events
    for column, value in (("zone_id", by.zone_id), ("alert_level", by.alert_level),
                          ("predicted_fault", by.fault_type)):
        if value is not None:
            events = events.filter(F.col(column) == value)
    return events


def count_detections(events: DataFrame, by: DetectionFilter = DetectionFilter()) -> DataFrame:
    return filter_detections(events, by).agg(F.count("*").alias("total"))


def detection_page(events: DataFrame, by: DetectionFilter = DetectionFilter(),
                   page_size: int = PAGE_DEFAULT, skip: int = 0,
                   seek_beyond: int = 100 * PAGE_MOST) -> DataFrame:
    """Matching events, newest first; ids break ties.

    Spark keeps the ``skip + page_size`` newest rows of each task. For a page
    deeper than ``seek_beyond`` what lies before it is counted and left out
    first: whole days, then hours, and so on to instants and ranges of ids.
    """
    if not 1 <= page_size <= PAGE_MOST:
        raise ValueError(f"page_size must be between 1 and {PAGE_MOST}")
    if skip < 0:
        raise ValueError("skip must not be negative")
    matching = filter_detections(events, by)
    for unit in ("day", "hour", "minute", "second", "microsecond"):
        if skip > seek_beyond:
            stored_day = unit == "day" and DATE in matching.columns
            key = F.col(DATE) if stored_day else F.date_trunc(unit, "event_time")
            matching, skip = _leave_out(matching, [key], skip, page_size)
    if skip > seek_beyond:
        matching, skip = _leave_out(matching, [F.col("event_time"), F.shiftright("id", 48)], skip, page_size)
    return matching.orderBy(F.col("event_time").desc(), F.col("id").desc()).offset(skip).limit(page_size)


@dataclass(frozen=True)
class PageToken:
    """Where a page ended: its last row's time and id."""

    event_time: datetime
    id: int


def token_of(page: DataFrame) -> PageToken | None:
    """The token of a page, which holds at most ``PAGE_MOST`` rows; None if the page is empty."""
    last = page.orderBy("event_time", "id").select("event_time", "id").first()
    return None if last is None else PageToken(last["event_time"], last["id"])


def page_after(events: DataFrame, token: PageToken | None = None, by: DetectionFilter = DetectionFilter(),
               page_size: int = PAGE_DEFAULT) -> DataFrame:
    """The page behind ``token``, newest first; the first page without one.

    The plan and its cost are the same at every depth: a scan that leaves out newer days and keeps
    ``page_size`` rows of each task. Rows inserted meanwhile move no page, as they would with an offset.
    Rows that share time and id are one position: the page after them leaves all of them out, so ids
    must be unique within an instant.
    """
    if not 1 <= page_size <= PAGE_MOST:
        raise ValueError(f"page_size must be between 1 and {PAGE_MOST}")
    rows = filter_detections(events, by)
    if token is not None:
        instant = F.lit(token.event_time)
        rows = filter_detections(rows, DetectionFilter(end=token.event_time)).filter(
            (F.col("event_time") < instant) | ((F.col("event_time") == instant) & (F.col("id") < token.id)))
    return rows.orderBy(F.col("event_time").desc(), F.col("id").desc()).limit(page_size)


def _leave_out(matching: DataFrame, key: list[Column], skip: int, page_size: int) -> tuple[DataFrame, int]:
    """Only the groups of ``key`` that hold rows of the page, and the rows still to skip in them.

    A key must follow the order of the page. It has few values among rows that
    coarser keys have left: 24 hours, 60 minutes, a million instants.
    """
    group = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(key)])
    newer = Window.orderBy(F.col("group").desc()).rowsBetween(Window.unboundedPreceding, -1)
    touched = (
        matching.groupBy(group.alias("group")).agg(F.count("*").alias("rows"))
        .withColumn("newer", F.coalesce(F.sum("rows").over(newer), F.lit(0)))
        .filter((F.col("newer") < skip + page_size) & (F.col("newer") + F.col("rows") > skip))
        .agg(F.min("group").alias("first"), F.max("group").alias("last"), F.min("newer").alias("newer"))
        .first()
    )
    if touched["first"] is None:
        return matching.limit(0), 0
    first, last = touched["first"], touched["last"]
    # the plain condition on the first column is one that a scan can use
    inside = matching.filter(key[0].between(F.lit(first[0]), F.lit(last[0])))
    if len(key) > 1:
        low, high = [F.struct(*[F.lit(v).alias(f"k{i}") for i, v in enumerate(end)]) for end in (first, last)]
        inside = inside.filter(group.between(low, high))
    return inside, skip - touched["newer"]


def detection_statistics(events: DataFrame) -> DataFrame:
    """Counts in total and by level, fault and equipment, from one pass.

    ``dimension`` is total, alert_level, fault_type or equipment. A null and an
    empty fault are both 'unknown' and counted together.
    """
    rows = events.select("alert_level", or_unknown(F.col("predicted_fault")).alias("fault_type"), "equipment_id")
    sets = [[], ["alert_level"], ["fault_type"], ["equipment_id"]]
    grouped = rows.groupingSets(sets, "alert_level", "fault_type", "equipment_id").agg(
        F.count("*").alias("detections"),
        F.grouping_id("alert_level", "fault_type", "equipment_id").alias("_set"),
    )
    # one bit per column left out of the grouping: 7 is none kept, 3 level, 5 fault, 6 equipment
    dimension = F.create_map(*[F.lit(v) for v in (7, "total", 3, "alert_level", 5, "fault_type", 6, "equipment")])
    value = F.when(F.col("_set") == 3, F.col("alert_level")).when(F.col("_set") == 5, F.col("fault_type")).when(
        F.col("_set") == 6, F.col("equipment_id"))
    return grouped.select(
        dimension[F.col("_set").cast("int")].alias("dimension"), value.alias("value"), "detections"
    )


def event_view(events: DataFrame) -> DataFrame:
    """Events for BI: labels filled, id renamed."""
    return events.select(
        F.col("id").alias("detection_id"), "event_time", "created_at", "zone_id", "equipment_id",
        "detector_source", "violated_policy", "trigger_signal", "anomaly_index", "alert_level",
        F.coalesce("ground_truth", F.lit("unknown")).alias("ground_truth"),
        F.coalesce("predicted_fault", F.lit("unknown")).alias("predicted_fault"),
        "confidence",
    )


def daily_view(view: DataFrame) -> DataFrame:
    """Daily cube of ``event_view``."""
    return (
        view.groupBy(
            F.to_date("event_time").alias("event_date"), "equipment_id", "zone_id",
            "alert_level", "predicted_fault", "detector_source",
        )
        .agg(
            F.count("*").alias("detection_count"),
            F.avg("anomaly_index").alias("mean_anomaly_index"),
            F.avg("confidence").alias("mean_confidence"),
        )
    )


def run_view(jobs: DataFrame) -> DataFrame:
    """Jobs for BI, with the duration in seconds."""
    seconds = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / F.lit(1e6)
    return jobs.select(
        F.col("id").alias("pipeline_job_id"), "scenario", "status", "started_at", "finished_at",
        seconds.alias("duration_sec"), "records_processed", "anomalies_found", "error_msg",
    )


def register_views(events: DataFrame, jobs: DataFrame) -> None:
    """The three BI views as temporary views of the session."""
    view = event_view(events)
    view.createOrReplaceTempView("vw_detection_events")
    daily_view(view).createOrReplaceTempView("vw_detection_daily")
    run_view(jobs).createOrReplaceTempView("vw_pipeline_runs")


def recent_jobs(jobs: DataFrame, limit: int = JOBS_DEFAULT) -> DataFrame:
    return jobs.orderBy(F.col("started_at").desc(), F.col("id").desc()).limit(limit)


def job_by_id(jobs: DataFrame, job_id: int) -> DataFrame:
    return jobs.filter(F.col("id") == job_id)
