"""Stores of events and jobs, and report files."""

from __future__ import annotations

import secrets
import threading
from collections.abc import Sequence
from datetime import datetime

from py4j.java_gateway import JavaObject
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airsleuth.errors import ReportError, StoreError
from airsleuth.schema import EVENT_SCHEMA, JOB_SCHEMA, SCENARIO

DATE = "event_date"
RUN = "run"
TERMINAL = ("done", "failed")
REPORT_FORMATS = ("json",)


# --- events ----------------------------------------------------------------------


def with_event_id(events: DataFrame) -> DataFrame:
    """A number that the event's content alone decides, so a repeated task assigns the same."""
    content = [c for c in EVENT_SCHEMA.names if c in events.columns and c not in ("id", "created_at")]
    return events.withColumn("id", F.xxhash64(*content))


def insert_events(events: DataFrame, path: str, created_at: datetime | None = None, run: str | None = None) -> int:
    """Append events, partitioned by day; returns the rows written.

    With a ``run`` key the events stand in folders of their own below each day, and storing a run
    again replaces them, so that a repeated run stores nothing twice.

    The rebalance hint lets the adaptive plan cut a day with many events into
    several files and put quiet days into one.
    """
    created = F.current_timestamp() if created_at is None else F.lit(created_at)
    rows = with_event_id(events).withColumns({"created_at": created, DATE: F.to_date("event_time")})
    written = Observation()
    counted_rows = rows.select(*EVENT_SCHEMA.names, DATE).observe(written, F.count("*").alias("rows"))
    if run is None:
        counted_rows.hint("rebalance", DATE).write.mode("append").partitionBy(DATE).parquet(path)
    else:
        (
            counted_rows.withColumn(RUN, F.lit(run)).hint("rebalance", DATE).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy(RUN, DATE).parquet(path)
        )
    return written.get["rows"]


def read_events(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(T.StructType([*EVENT_SCHEMA, T.StructField(DATE, T.DateType())])).parquet(path)
    except AnalysisException as error:
        raise StoreError(f"cannot read events in {path}: {error}") from error


# --- jobs ------------------------------------------------------------------------


def latest_jobs(transitions: DataFrame) -> DataFrame:
    """Current state of each job from its transitions.

    A transition has the job columns and ``seq``. A field keeps its last value
    that is not null; ``finished_at`` comes from terminal transitions only.
    """
    def last(column: str) -> Column:
        return F.max_by(column, F.when(F.col(column).isNotNull(), F.col("seq"))).alias(column)

    at_end = F.when(F.col("status").isin(*TERMINAL), F.col("finished_at"))
    columns = [last(c) for c in JOB_SCHEMA.names if c not in ("id", "started_at", "finished_at")]
    return (
        transitions.withColumn("finished_at", at_end).groupBy("id")
        .agg(F.min("started_at").alias("started_at"), last("finished_at"), *columns)
        .select(*JOB_SCHEMA.names)
    )


class JobLog:
    """Append-only log of job transitions.

    Job ids and the places of transitions are numbers claimed by creating a file that must not exist yet, which
    file systems of a cluster decide for one of all writers; writers of one driver also take turns, for local
    folders do not. So ids rise with age, and any two transitions have an order, however close in time.
    """

    _TURN = threading.Lock()

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._spark, self._path = spark, path.rstrip("/")

    def _folder(self, name: str) -> tuple[JavaObject, JavaObject]:
        place = self._spark._jvm.org.apache.hadoop.fs.Path(f"{self._path}/{name}")
        return place.getFileSystem(self._spark._jsc.hadoopConfiguration()), place

    def _names(self, folder: str) -> list[str]:
        system, place = self._folder(folder)
        return sorted(f.getPath().getName() for f in system.listStatus(place)) if system.exists(place) else []

    def _claim(self, counter: str) -> int:
        """The next number of a counter, never given to anyone else."""
        with self._TURN:
            taken = [int(n) for n in self._names(f"claims/{counter}") if n.isdigit()]
            number = max(taken, default=0) + 1
            while True:
                system, place = self._folder(f"claims/{counter}/{number:019d}")
                if system.createNewFile(place):
                    return number
                number += 1

    def transitions(self) -> DataFrame:
        """All transitions with their place ``seq``, once each, also while the log is being compacted."""
        schema = T.StructType([*JOB_SCHEMA, T.StructField("seq", T.LongType())])
        steps = [n for n in self._names("steps") if not n.startswith(("_", "."))]
        if not steps:
            return self._spark.createDataFrame([], schema)
        return self._spark.read.schema(schema).parquet(*[f"{self._path}/steps/{n}" for n in steps]).dropDuplicates(["seq"])

    def jobs(self) -> DataFrame:
        return latest_jobs(self.transitions())

    def _append(self, **values: object) -> None:
        seq = self._claim("steps")
        row = self._spark.range(1).select(
            *[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name)
              if f.name not in ("started_at", "finished_at") or f.name not in values
              else F.current_timestamp().alias(f.name) for f in JOB_SCHEMA],
            F.lit(seq).cast("long").alias("seq"),
        )
        row.write.parquet(f"{self._path}/steps/{seq:019d}")

    def create(self, scenario: str) -> int:
        """A new job, pending; returns its id."""
        job = self._claim("jobs")
        self._append(id=job, scenario=scenario, status="pending", started_at=True)
        return job

    def update(self, job_id: int, status: str, error_msg: str | None = None,
               records_processed: int | None = None, anomalies_found: int | None = None) -> None:
        if self.transitions().filter(F.col("id") == job_id).isEmpty():
            raise StoreError(f"job {job_id} not found")
        end = {"finished_at": True} if status in TERMINAL else {}
        self._append(id=job_id, status=status, error_msg=error_msg,
                     records_processed=records_processed, anomalies_found=anomalies_found, **end)

    def compact(self) -> int:
        """Put all transitions into one folder, and drop what that makes needless; returns the folders replaced.

        What is appended meanwhile stays as it is. A reader sees transitions twice at worst, and takes them once.
        """
        before = [n for n in self._names("steps") if not n.startswith(("_", "."))]
        if len(before) < 2:
            return 0
        self.transitions().filter(F.col("seq") <= int(before[-1].split("-")[0])).coalesce(1).write.parquet(
            f"{self._path}/steps/{before[-1].split('-')[0]}-{secrets.token_hex(8)}")
        for name in before:
            system, place = self._folder(f"steps/{name}")
            system.delete(place, True)
        for counter in ("jobs", "steps"):
            for name in self._names(f"claims/{counter}")[:-1]:
                system, place = self._folder(f"claims/{counter}/{name}")
                system.delete(place, False)
        return len(before)


# --- reports and counts ----------------------------------------------------------


def write_report(metrics: DataFrame, path: str, formats: Sequence[str] = REPORT_FORMATS) -> None:
    """Metric rows as JSON lines; null fields are kept."""
    unknown = sorted(set(formats) - set(REPORT_FORMATS))
    if unknown:
        raise ReportError(f"unsupported report formats: {unknown}; supported: {list(REPORT_FORMATS)}")
    metrics.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    """``df`` and an observation that holds its ``rows`` after the next action on it."""
    seen = Observation()
    return df.observe(seen, F.count("*").alias("rows")), seen


def ingest_counts(df: DataFrame) -> DataFrame:
    """Rows, scenario files and columns of an ingest run."""
    return df.agg(
        F.count("*").alias("rows"), F.count_distinct(SCENARIO).alias("frames"),
        F.lit(len(df.columns)).alias("columns"),
    )
