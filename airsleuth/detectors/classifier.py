"""Supervised fault classifier over interchangeable backends."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airsleuth.detectors.backends import BACKENDS, Backend, load_models, save_models
from airsleuth.detectors.base import Detector, calibrated_threshold, read_state, to_hits, write_state
from airsleuth.functions.columns import alert_level, complete
from airsleuth.operators.splits import complete_rows
from airsleuth.schema import FEATURES, NORMAL, ROW_KEYS, SEQ

SIGNAL, SOURCE = "fault_classifier", "classifier"
# --- fixed values: thresholds ----------------------------------------------------
CONFIDENCE_CRITICAL, CONFIDENCE_WARNING, ANOMALY_THRESHOLD = 0.80, 0.50, 0.5


def verdict(df: DataFrame, classes: list[str], probability: str = "probability") -> DataFrame:
    """Add ``predicted_fault`` (first of the most likely classes), ``confidence`` and
    ``score``, the probability of not being normal."""
    if NORMAL not in classes:
        raise ValueError(f"{NORMAL!r} must be one of the classes")
    p = F.col(probability)
    top = F.array_max(p)
    return df.withColumns({
        "predicted_fault": F.element_at(F.lit(classes), F.array_position(p, top).cast("int")),
        "confidence": top,
        "score": 1 - F.element_at(p, classes.index(NORMAL) + 1),
    })


def fault_hits(judged: DataFrame, threshold: float | Column = ANOMALY_THRESHOLD) -> DataFrame:
    """Rows judged faulty: not normal, and anomalous enough."""
    faulty = judged.filter((F.col("predicted_fault") != NORMAL) & (F.col("score") >= threshold))
    return to_hits(
        faulty, F.col("predicted_fault"),
        alert_level(F.col("confidence"), CONFIDENCE_WARNING, CONFIDENCE_CRITICAL),
        SIGNAL, SOURCE, ["predicted_fault", "confidence"],
    )


def columns_read(df: DataFrame) -> DataFrame:
    """What a classifier reads of feature rows, so that no other column is sorted or moved."""
    return df.select(*[c for c in dict.fromkeys([*ROW_KEYS, SEQ, "fault_type", *FEATURES]) if c in df.columns])


class FaultClassifier(Detector):
    """Labels rows with fault types."""

    def __init__(self, backend: str = "boosted", seed: int = 42, **options: Any) -> None:
        if backend not in BACKENDS:
            raise ValueError(f"unknown backend {backend!r}; known: {sorted(BACKENDS)}")
        self.backend: Backend = BACKENDS[backend](seed, **options)
        self.threshold = ANOMALY_THRESHOLD

    def fit(self, df: DataFrame) -> FaultClassifier:
        rows = self.backend.kept(columns_read(complete_rows(df, ["fault_type", "scenario_file"])))
        classes = sorted(r[0] for r in rows.select("fault_type").distinct().collect())
        if NORMAL not in classes:
            raise ValueError(f"training rows must include {NORMAL!r} ones")
        self.backend.fit(rows, classes)
        self.fitted = True
        return self

    def judge(self, df: DataFrame) -> DataFrame:
        """Verdict on every complete row."""
        self.require_fitted()
        scored = self.backend.probabilities(df.filter(complete(FEATURES)))
        return verdict(scored, self.backend.classes)

    def predict(self, df: DataFrame) -> DataFrame:
        return fault_hits(self.judge(columns_read(df)), self.threshold)

    def calibrate(self, validation: DataFrame, target_fpr: float) -> FaultClassifier:
        """Set the anomaly threshold so that ``target_fpr`` of the normal rows exceed it."""
        self.require_fitted()
        normals = validation.filter(F.col("fault_type") == NORMAL)
        self.threshold = calibrated_threshold(self.judge(columns_read(normals)), target_fpr)
        return self

    def save(self, spark: SparkSession, path: str) -> None:
        self.require_fitted()
        kinds = save_models(self.backend, path)
        write_state(spark, path, {"backend": self.backend.state(), "models": kinds, "threshold": self.threshold})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FaultClassifier:
        state = read_state(spark, path)
        kept = state["backend"]
        classifier = cls(kept["kind"], kept["seed"], **kept["options"])
        classifier.backend.restore(kept)
        classifier.backend.take(load_models(path, state["models"]))
        classifier.threshold, classifier.fitted = state["threshold"], True
        return classifier
