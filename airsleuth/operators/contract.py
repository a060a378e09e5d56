"""The contract an event must meet to be stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airsleuth.schema import ALERT_LEVELS, FAULT_TYPES

EQUIPMENT = "AHU-1"
EVENT_COLUMNS = [
    "event_time", "zone_id", "equipment_id", "detector_source", "violated_policy",
    "trigger_signal", "anomaly_index", "alert_level", "ground_truth", "predicted_fault", "confidence",
]
# --- fixed values: (shortest, longest) text --------------------------------------
LENGTHS = {
    "zone_id": (1, 32), "equipment_id": (1, 32), "detector_source": (0, 32),
    "violated_policy": (0, 64), "trigger_signal": (0, 64),
}


def to_events(hits: DataFrame, equipment: str = EQUIPMENT) -> DataFrame:
    """Hits as event rows; what the hits do not carry is null."""
    absent = {c: F.lit(None).cast(t) for c, t in
              [("ground_truth", "string"), ("predicted_fault", "string"), ("confidence", "double")]
              if c not in hits.columns}
    return (
        hits.withColumns({**absent, "equipment_id": F.lit(equipment)})
        .withColumn("confidence", F.nullif("confidence", F.lit(float("nan"))))
        .select(*EVENT_COLUMNS)
    )


def reject_reason() -> Column:
    """Name of the first column that breaks the contract, else null."""
    reason = F.when(F.col("event_time").isNull(), F.lit("event_time"))
    for name, (low, high) in LENGTHS.items():
        good = F.coalesce(F.length(name).between(low, high), F.lit(False))
        reason = reason.when(~good, F.lit(name))
    index, confidence = F.col("anomaly_index"), F.col("confidence")
    reason = reason.when(index.isNull() | F.isnan(index) | (index < 0), F.lit("anomaly_index"))
    reason = reason.when(~F.coalesce(F.col("alert_level").isin(ALERT_LEVELS), F.lit(False)), F.lit("alert_level"))
    for name in ("ground_truth", "predicted_fault"):
        reason = reason.when(~F.col(name).isin(FAULT_TYPES), F.lit(name))
    return reason.when(~confidence.between(0.0, 1.0), F.lit("confidence"))


def check_contract(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events that may be stored, rejected events with their ``reason``)."""
    tested = events.withColumn("reason", reject_reason())
    return tested.filter(F.col("reason").isNull()).drop("reason"), tested.filter(F.col("reason").isNotNull())
