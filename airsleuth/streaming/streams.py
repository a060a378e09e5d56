"""Streaming twins of the batch operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from airsleuth.operators.features import INPUTS, LONGEST, build_features
from airsleuth.operators.ordered import Order, last_rows
from airsleuth.operators.rules import READ, rule_events
from airsleuth.schema import ROW_KEYS, SEQ, SERIES_KEYS, TIME
from airsleuth.session import cut_lineage

BURST_GAP = "5 minutes"


def daily_counts(events: DataFrame, by: Sequence[str], late: str = "1 day") -> DataFrame:
    """Events per day; a day is final once the watermark has passed its end."""
    return (
        events.withWatermark(TIME, late)
        .groupBy(F.window(TIME, "1 day").alias("day"), *by)
        .agg(F.count("*").alias("detection_count"))
        .select(F.col("day.start").alias("day_start"), *by, "detection_count")
    )


def burst_sessions(events: DataFrame, gap: str = BURST_GAP, late: str = "1 day",
                   keys: Sequence[str] = tuple(SERIES_KEYS)) -> DataFrame:
    """Alert bursts as session windows; emitted once no event can extend them."""
    return (
        events.withWatermark(TIME, late)
        .groupBy(F.session_window(TIME, gap).alias("_session"), *keys)
        .agg(F.min(TIME).alias("burst_start"), F.max(TIME).alias("burst_end"), F.count("*").alias("rows"))
        .drop("_session")
    )


def distinct_events(events: DataFrame, late: str = "1 day", keys: Sequence[str] = tuple(ROW_KEYS)) -> DataFrame:
    """The first event that arrives per key; repeats within the watermark are dropped."""
    return events.withWatermark(TIME, late).dropDuplicatesWithinWatermark(list(keys))


class RuleStream:
    """Rule events of normalized rows that arrive in time order per series.

    Row frames reach back 119 rows, so the last rows of every series are kept
    between batches. A batch writes its events and the kept rows to folders of
    its own number: when it is repeated after a failure it writes the same again.
    Of a batch only what features and rules read is written, moved and kept.
    """

    def __init__(self, spark: SparkSession, folder: str, order: Order = Order()) -> None:
        self._spark, self._order = spark, order
        self._events, self._kept = f"{folder}/events", f"{folder}/kept"

    def _before(self, batch_id: int) -> DataFrame | None:
        """Rows kept by the batch before; only the first has none. A lost folder is an error, not an empty past."""
        return self._spark.read.parquet(f"{self._kept}/batch={batch_id - 1}") if batch_id else None

    def process(self, batch: DataFrame, batch_id: int) -> None:
        identity = {*ROW_KEYS, SEQ, "fault_type", *self._order.keys, *self._order.columns}
        read = [c for c in batch.columns if c in {*identity, *INPUTS}]
        new = cut_lineage(batch.select(*read)).withColumn("_new", F.lit(True))  # read from its source once
        before = self._before(batch_id)
        rows = new if before is None else new.unionByName(before.select(*read).withColumn("_new", F.lit(False)))
        events = rule_events(build_features(rows, self._order, keep=[*identity, *READ, "_new"]).filter("_new"))
        events.write.mode("overwrite").parquet(f"{self._events}/batch={batch_id}")
        (
            last_rows(rows, LONGEST - 1, self._order, self._order.keys)
            .drop("_from_end", "_new").write.mode("overwrite").parquet(f"{self._kept}/batch={batch_id}")
        )

    def writer(self, rows: DataFrame, checkpoint: str) -> DataStreamWriter:
        return rows.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)

    def events(self) -> DataFrame:
        return self._spark.read.parquet(self._events).drop("batch")


def drain(stream: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Run an appending stream over what is there now, and return what it wrote."""
    run = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out")
    )
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def drain_whole(stream: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Run an aggregating stream over an input that has ended, and return all its groups.

    What the watermark has not passed is in the result too, since no more rows can come.
    Each batch writes the whole result to a folder of its own, and the last one counts.
    """
    def write(result: DataFrame, batch_id: int) -> None:
        result.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    run = (
        stream.writeStream.foreachBatch(write).outputMode("complete")
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    batches = run.recentProgress
    if not batches:
        return spark.createDataFrame([], stream.schema)
    last = max(p["batchId"] for p in batches)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out/batch={last}")
