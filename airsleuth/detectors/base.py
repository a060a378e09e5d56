"""What all detectors share."""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airsleuth.errors import DetectorNotFittedError
from airsleuth.functions.columns import alert_level
from airsleuth.functions.quantiles import exact_quantiles
from airsleuth.operators.rules import rule_events
from airsleuth.schema import HIT_COLUMNS, NORMAL, SCENARIO
from airsleuth.session import cut_lineage

STATE = "state"


class Detector(ABC):
    """``fit`` learns from feature rows, ``predict`` returns hits of the flagged rows."""

    fitted = False

    def fit(self, df: DataFrame) -> Detector:
        """Nothing to learn, unless a detector says otherwise."""
        self.fitted = True
        return self

    @abstractmethod
    def predict(self, df: DataFrame) -> DataFrame:
        """Hits in the columns scenario_file + HIT_COLUMNS."""

    def fit_predict(self, df: DataFrame) -> DataFrame:
        return self.fit(df).predict(df)

    def require_fitted(self) -> None:
        if not self.fitted:
            raise DetectorNotFittedError(f"{type(self).__name__} must be fitted first")


class RuleDetector(Detector):
    """The physics rules; needs no fit."""

    fitted = True

    def predict(self, df: DataFrame) -> DataFrame:
        return rule_events(df)


class ScoreDetector(Detector):
    """An unsupervised detector: a score per row, and two thresholds on it."""

    policy = "ANOMALY_SCORE"
    signal = ""
    source = ""
    percentiles = (0.90, 0.99)

    def __init__(self) -> None:
        self.warning = 0.0
        self.critical = 0.0

    @abstractmethod
    def score(self, df: DataFrame) -> DataFrame:
        """Complete rows of ``df`` with ``score``, higher meaning stranger."""

    @abstractmethod
    def parameters(self) -> dict[str, Any]:
        """What was learned, as JSON values."""

    @abstractmethod
    def restore(self, parameters: dict[str, Any]) -> None:
        """Take over what ``parameters`` returned."""

    def set_thresholds(self, normals: DataFrame) -> None:
        """Thresholds from the scores of the training rows."""
        self.fitted = True
        scores = cut_lineage(self.score(normals).select("score"))
        self.warning, self.critical = exact_quantiles(scores, "score", self.percentiles)

    def calibrate(self, validation: DataFrame, target_fpr: float) -> ScoreDetector:
        """Set the warning threshold so that ``target_fpr`` of the normal rows exceed it."""
        self.require_fitted()
        self.warning = calibrated_threshold(self.score(validation.filter(F.col("fault_type") == NORMAL)), target_fpr)
        self.critical = max(self.critical, self.warning)
        return self

    def flag(self, scored: DataFrame) -> DataFrame:
        return scored.filter(F.col("score") >= self.warning)

    def predict(self, df: DataFrame) -> DataFrame:
        self.require_fitted()
        return to_hits(
            self.flag(self.score(df)), F.lit(self.policy),
            alert_level(F.col("score"), self.warning, self.critical), self.signal, self.source,
        )

    def save(self, spark: SparkSession, path: str) -> None:
        self.require_fitted()
        write_state(spark, path, {
            "warning": self.warning, "critical": self.critical, "parameters": self.parameters(),
        })

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ScoreDetector:
        state = read_state(spark, path)
        detector = cls()
        detector.restore(state["parameters"])
        detector.warning, detector.critical = state["warning"], state["critical"]
        detector.fitted = True
        return detector


def to_hits(scored: DataFrame, policy: Column, level: Column, signal: str, source: str,
            extra: Sequence[str] = ()) -> DataFrame:
    """Flagged rows with ``score`` in the columns of hits; a row's label rides along."""
    truth = F.col("fault_type") if "fault_type" in scored.columns else F.lit(None)
    return scored.withColumns({
        "violated_policy": policy,
        "alert_level": level,
        "anomaly_index": F.col("score"),
        "trigger_signal": F.lit(signal),
        "detector_source": F.lit(source),
        "ground_truth": truth.cast("string"),
    }).select(SCENARIO, *HIT_COLUMNS, *extra)


def calibrated_threshold(normal_scores: DataFrame, target_fpr: float) -> float:
    """The score that a share of ``target_fpr`` of the normal rows exceeds."""
    if not 0.0 < target_fpr < 1.0:
        raise ValueError("target_fpr must be between 0 and 1")
    found = exact_quantiles(cut_lineage(normal_scores.select("score")), "score", [1.0 - target_fpr])
    if found is None:
        raise ValueError("validation data has no complete normal rows")
    return found[0]


def write_state(spark: SparkSession, path: str, state: dict[str, Any]) -> None:
    spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{STATE}")


def read_state(spark: SparkSession, path: str) -> dict[str, Any]:
    return json.loads(spark.read.text(f"{path}/{STATE}").first()[0])
