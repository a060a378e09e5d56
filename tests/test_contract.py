"""The contracts of trained detectors name what is broken."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from airsleuth.detectors.base import ScoreDetector
from airsleuth.detectors.classifier import FaultClassifier
from airsleuth.detectors.contract import classified_contract, classifier_contract, fused_contract, score_contract, share_kept
from airsleuth.detectors.scores import MixtureDetector
from airsleuth.schema import FAULT_TYPES
from airsleuth.session import cut_lineage
from tests.frames import separable_frame


@pytest.fixture(scope="module")
def rows(spark):
    return cut_lineage(spark.createDataFrame(separable_frame()))


def test_share_holds_with_ties(spark):
    draw = np.random.default_rng(0)
    for values in (draw.normal(size=101), draw.integers(0, 4, 97), np.zeros(20), np.arange(1.0)):
        scores = spark.createDataFrame([(float(v),) for v in values], "score double")
        for share in (0.05, 0.1, 0.5):
            assert share_kept(scores, float(np.quantile(values, 1 - share)), share)
    even = spark.range(100).select(F.col("id").cast("double").alias("score"))
    assert not share_kept(even, 80.0, 0.1) and not share_kept(even, 98.0, 0.1) and not share_kept(even.limit(0), 0.0, 0.1)


class _Forgetful(MixtureDetector):
    @classmethod
    def load(cls, spark, path):
        detector = ScoreDetector.load.__func__(cls, spark, path)
        detector.scaler.means[0] += 1.0
        return detector


def test_a_changed_model_and_threshold_are_seen(spark, rows, tmp_path):
    good = MixtureDetector(components=1, covariance="diag").fit(rows)
    kept = score_contract(spark, good, rows, rows, str(tmp_path / "good")).collect()
    assert all(r.n == r.n_valid > 0 and r.n_changed == 0 and r.share_kept for r in kept) and sum(r.n for r in kept) == rows.count()
    bad = _Forgetful(components=1, covariance="diag").fit(rows)
    bad.warning = bad.critical * 2
    broken = score_contract(spark, bad, rows, rows, str(tmp_path / "bad")).collect()
    assert all(r.n_changed == r.n and not r.share_kept for r in broken)


def test_classes_without_a_whole_window_have_a_probability(spark, rows, tmp_path):
    """The last class of all is on a few rows of a series only."""
    last = sorted(FAULT_TYPES)[-1]
    few = rows.filter((F.col("fault_type") != last) | (F.col("row_seq") < 5))
    classifier = FaultClassifier("sequence").fit(few)
    found = classifier_contract(spark, classifier, rows, rows, str(tmp_path / "model"), 0.1).collect()
    assert sum(r.n for r in found) == rows.count()
    assert all(r.n == r.n_valid and r.n_changed == 0 and r.share_kept for r in found)


def test_events_that_break_a_contract_are_counted(spark):
    schema = ("scenario_file string, event_time timestamp, zone_id string, detector_source string, violated_policy string, "
              "predicted_fault string, ground_truth string, all_sources string")
    from datetime import datetime
    t = [datetime(2024, 1, 1, 0, m) for m in range(4)]
    keys = spark.createDataFrame([("s", x, "z") for x in t[:3]], "scenario_file string, event_time timestamp, zone_id string")
    events = spark.createDataFrame([
        ("s", t[0], "z", "classifier", "coi_bias", "coi_bias", "normal", "classifier"),
        ("s", t[1], "z", "classifier", "coi_bias", "normal", None, "classifier"),
        ("s", t[1], "z", "classifier", "coi_bias", "coi_bias", "normal", "classifier"),
        ("s", t[3], "z", "rules", "coi_bias", "coi_bias", "normal", "classifier|rules")], schema)
    found = classified_contract(keys, events).first()
    assert (found.n_keys, found.n_repeated, found.n_odd) == (3, 2, 2)


def test_fused_events_name_the_rules(spark, features):
    from airsleuth.detectors.base import RuleDetector
    from airsleuth.plans.detection import detect

    events = cut_lineage(detect(features, [RuleDetector()]))
    whole = fused_contract(features, events).collect()
    assert whole and all(r.n_rules == r.n_named > 0 and r.n_unfounded + r.n_repeated + r.n_unlabelled == 0 for r in whole)
    one = whole[0].scenario_file
    dropped = events.filter(F.col("scenario_file") != one).unionByName(events.filter(F.col("scenario_file") == one).limit(1))
    assert {r.scenario_file: r.n_named for r in fused_contract(features, dropped).collect()}[one] == 1
