"""From detector hits to one event per row key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airsleuth.functions.columns import known_fault, known_level
from airsleuth.schema import FEATURES, HIT_COLUMNS, ROW_KEYS, SCENARIO, SEQ


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by column name."""
    return reduce(DataFrame.unionByName, frames)


def _strongest_first() -> Column:
    """Highest index first; ties go to the rules, then by policy and signal."""
    return F.struct(
        -F.col("anomaly_index"),
        F.when(F.col("detector_source") == "rules", 0).otherwise(1),
        "detector_source", "violated_policy", "trigger_signal",
    )


def fuse(hits: DataFrame) -> DataFrame:
    """The strongest hit per row key, and all sources that agree, as ``all_sources``.

    One aggregate gives both, so no join back is needed, and all hits of a key
    in a task shrink to one row before the shuffle.
    """
    body = [c for c in HIT_COLUMNS if c not in ROW_KEYS]
    return (
        hits.groupBy(*ROW_KEYS)
        .agg(
            F.min_by(F.struct(*body), _strongest_first()).alias("_best"),
            F.array_join(F.sort_array(F.collect_set("detector_source")), "|").alias("all_sources"),
        )
        .select(SCENARIO, "event_time", "zone_id", *[f"_best.{c}" for c in body], "all_sources")
    )


def agreed_by_several(events: DataFrame) -> DataFrame:
    """Counts of events and of those with more than one source."""
    return events.agg(
        F.count("*").alias("events"),
        F.count_if(F.col("all_sources").contains("|")).alias("multi_source"),
    )


def event_keys(events: DataFrame) -> DataFrame:
    return events.select(*ROW_KEYS).distinct()


def flagged_rows(features: DataFrame, events: DataFrame) -> DataFrame:
    """Feature rows whose key was flagged; only these are worth classifying, and only what classifiers read."""
    read = [c for c in dict.fromkeys([*ROW_KEYS, SEQ, "fault_type", *FEATURES]) if c in features.columns]
    return features.select(*read).join(events.select(*ROW_KEYS), ROW_KEYS, "left_semi")


def first_labels(rows: DataFrame) -> DataFrame:
    """First label per row key."""
    return rows.groupBy(*ROW_KEYS).agg(F.min_by("fault_type", SEQ).alias("ground_truth"))


def annotate(events: DataFrame, classified: DataFrame) -> DataFrame:
    """Attach predicted fault and confidence; null where the classifier said nothing."""
    verdicts = classified.groupBy(*ROW_KEYS).agg(
        F.max_by(F.struct("predicted_fault", "confidence"), F.struct("confidence", "predicted_fault")).alias("_v")
    ).select(*ROW_KEYS, "_v.*")
    return events.drop("predicted_fault", "confidence").join(verdicts, ROW_KEYS, "left")


def attach_truth(events: DataFrame, rows: DataFrame) -> DataFrame:
    """Set ``ground_truth`` from the labels of the source rows."""
    if "fault_type" not in rows.columns:
        return events
    return events.drop("ground_truth").join(first_labels(rows), ROW_KEYS, "left")


def lenient_labels(events: DataFrame) -> DataFrame:
    """Unknown faults become null, unknown levels INFO."""
    return events.withColumns({
        "ground_truth": known_fault(F.col("ground_truth")),
        "predicted_fault": known_fault(F.col("predicted_fault")),
        "alert_level": known_level(F.col("alert_level")),
    })
