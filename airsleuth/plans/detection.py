"""Whole runs: train, detect, store, evaluate, hold out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airsleuth.detectors.base import Detector
from airsleuth.detectors.classifier import FaultClassifier
from airsleuth.operators.contract import EQUIPMENT, check_contract, to_events
from airsleuth.operators.evaluation import (
    alert_bursts, class_report, class_summary, confusion_counts, detection_report, fault_recall,
    label_detections, scenario_report,
)
from airsleuth.operators.fusion import annotate, flagged_rows, fuse, lenient_labels, stack
from airsleuth.operators.splits import (
    contiguous_tail, normal_rows, only_scenario, sample_per_scenario, temporal_split, without_scenario,
)
from airsleuth.schema import HIT_COLUMNS, NORMAL, ROW_KEYS, SCENARIO, SEQ
from airsleuth.session import cut_lineage
from airsleuth.sources.cache import features_of_files
from airsleuth.sources.csv import find_files
from airsleuth.sources.store import JobLog, counted, insert_events, write_report


def detect(features: DataFrame, detectors: Sequence[Detector], classifier: FaultClassifier | None = None) -> DataFrame:
    """Fused, annotated and labelled events of all scenarios at once.

    Hits carry the label of their row, which a scenario's file decides, so no join looks it up.

    Without primary detectors the classifier's own hits are the events. A
    classifier that reads sequences sees whole series, others only flagged rows.
    """
    columns = [SCENARIO, *HIT_COLUMNS]
    if not detectors:
        if classifier is None:
            raise ValueError("detect needs a detector or a classifier")
        return lenient_labels(classifier.predict(features))
    events = cut_lineage(fuse(stack([d.predict(features).select(*columns) for d in detectors])))
    if classifier is None:
        events = events.withColumns({
            "predicted_fault": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double"),
        })
    else:
        whole_series = classifier.backend.kind == "sequence"
        rows = features if whole_series else flagged_rows(features, events)
        events = annotate(events, classifier.predict(rows))
    return lenient_labels(events)


@dataclass(frozen=True)
class Split:
    """Rows of one run by their use."""

    train: DataFrame
    validation: DataFrame
    evaluation: DataFrame


def split_rows(features: DataFrame, protocol: str = "annual", window: str = "final",
               held_out: str | None = None, with_normal_reference: bool = False) -> Split:
    """Train, validation and evaluation rows; a held-out scenario is only evaluated.

    Rows that have a ``split`` already keep it.
    """
    if window not in ("validation", "final"):
        raise ValueError(f"unknown evaluation window: {window!r}")
    rows = features if "split" in features.columns else temporal_split(features, protocol)

    def part(name: str) -> DataFrame:
        return rows.filter(F.col("split") == name).drop("split")

    return Split(
        without_scenario(part("train"), held_out), without_scenario(part("validation"), held_out),
        only_scenario(part(window), held_out, with_normal_reference),
    )


def training_sample(train: DataFrame, backend: str, share: float | None = None, seed: int = 42) -> DataFrame:
    """The ``share`` of each scenario that a classifier learns from: its tail for sequence models, else drawn at random.

    Without a share: all rows.
    """
    if share is None or share >= 1.0:
        return train
    if backend == "sequence":
        return contiguous_tail(train, share)
    return sample_per_scenario(train, [*ROW_KEYS, SEQ], seed, share)


def train_unsupervised(split: Split, detector: Detector, target_fpr: float | None = None) -> Detector:
    detector.fit(normal_rows(split.train))
    return detector if target_fpr is None else detector.calibrate(split.validation, target_fpr)


def train_classifier(split: Split, classifier: FaultClassifier, target_fpr: float | None = None,
                     share: float | None = None) -> FaultClassifier:
    """``share`` of each scenario's labelled rows is learned from; see ``training_sample``."""
    classifier.fit(training_sample(split.train, classifier.backend.kind, share))
    return classifier if target_fpr is None else classifier.calibrate(split.validation, target_fpr)


@dataclass(frozen=True)
class Evaluation:
    """Reports of a run as DataFrames."""

    overall: DataFrame
    per_fault: DataFrame
    per_scenario: DataFrame
    bursts: DataFrame
    classes: DataFrame | None = None
    summary: DataFrame | None = None


def evaluate(rows: DataFrame, events: DataFrame, used_classifier: bool = False) -> Evaluation:
    """All reports from one labelled table, which is written once and read by each."""
    prepared = label_detections(rows, events).withColumn(SEQ, F.lit(0).cast("long"))
    labelled = cut_lineage(prepared)
    counts = confusion_counts(labelled, "fault_type", "predicted_fault")
    return Evaluation(
        detection_report(labelled), fault_recall(labelled), scenario_report(labelled),
        alert_bursts(labelled.filter("detected")),
        class_report(counts) if used_classifier else None,
        class_summary(counts) if used_classifier else None,
    )


def store(events: DataFrame, path: str, equipment: str = EQUIPMENT, run: str | None = None) -> tuple[int, DataFrame]:
    """Store the events that meet the contract; returns their number and the rejected ones.

    With a ``run`` key storing the run again replaces its events.
    """
    valid, rejected = check_contract(to_events(events, equipment))
    return insert_events(valid, path, run=run), rejected


def fault_scenarios(features: DataFrame) -> list[str]:
    """Scenario files with faults, sorted; there are as many as input files."""
    found = features.filter(F.col("fault_type") != NORMAL).select(SCENARIO).distinct().collect()
    return sorted(r[0] for r in found)


def run_job(spark: SparkSession, log: JobLog, folder: str, scenario: str = "all", detectors: Sequence[Detector] = (),
            events_path: str | None = None, reports_path: str | None = None) -> int:
    """A run under a job: pending, running, then done with its counts or failed.

    Scenario files become features. With fitted ``detectors`` their events are stored in ``events_path`` under
    the job's own run key, so that a repeated insert doubles nothing, and the reports go to ``reports_path``, one folder each.
    """
    job = log.create(scenario)
    log.update(job, "running")
    try:
        built, seen = counted(features_of_files(spark, find_files(spark, folder, scenario)))
        found = 0
        if detectors:
            rows = cut_lineage(built)
            events = cut_lineage(detect(rows, detectors))
            if events_path is not None:
                found, _ = store(events, events_path, run=f"job-{job}")
            if reports_path is not None:
                reports = evaluate(rows, events)
                for name in ("overall", "per_fault", "per_scenario", "bursts"):
                    write_report(getattr(reports, name), f"{reports_path.rstrip('/')}/job-{job}/{name}")
        else:
            built.write.format("noop").mode("overwrite").save()
        log.update(job, "done", records_processed=seen.get["rows"], anomalies_found=found)
    except Exception as error:
        log.update(job, "failed", error_msg=str(error))
        raise
    return job
