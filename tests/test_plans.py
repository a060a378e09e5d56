"""What the physical plans must look like."""

from __future__ import annotations


from airsleuth.catalog.base import detections
from airsleuth.operators.features import add_windows, build_features, control_errors
from airsleuth.operators.fusion import fuse
from airsleuth.operators.reshape import normalize
from airsleuth.operators.rules import rule_events, rule_hits
from airsleuth.operators.serving import detection_page, detection_statistics
from tests.conftest import SF
from tests.frames import raw_frame


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_all_frames_share_one_shuffle_and_sort(spark):
    long = control_errors(normalize(spark.createDataFrame(raw_frame(20))))
    text = plan(add_windows(long, {f"m{n}": ("mean", "ra_sa_delta_c", n) for n in (15, 60, 120)} | {"d": ("std", "sf_power_w", 60), "l": ("lag", "oa_damper_pct", 1)}))
    assert text.count("Exchange hashpartitioning") == 1 and text.count("Sort [") == 1


def test_streamed_features_shuffle_once(spark):
    text = plan(build_features(normalize(spark.createDataFrame(raw_frame(20)))))
    assert text.count("Exchange hashpartitioning") == 1 and "MapInArrow" in text


def test_rules_shuffle_only_hits_after_a_partial_aggregate(features):
    text = plan(rule_events(features))
    assert text.count("Exchange hashpartitioning") == 1
    exchange = text.index("Exchange hashpartitioning")
    assert "partial_min_by" in text[exchange:] and "Filter" in text[exchange:]
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_rules_read_only_their_columns(features):
    scanned = plan(rule_hits(features).select("violated_policy")).split("FileScan parquet [")[1].split("]")[0]
    assert scanned.count("#") == 10 and "sf_power_w_60_std" in scanned


def test_fusion_is_one_aggregate(features):
    hits = rule_hits(features).select("scenario_file", "event_time", "zone_id", "violated_policy", "alert_level", "anomaly_index", "trigger_signal", "detector_source", "ground_truth")
    text = plan(fuse(hits))
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text


def test_statistics_scan_once(spark):
    text = plan(detection_statistics(detections(spark, SF)))
    assert text.count("FileScan") == 1 and "Expand" in text


def test_page_is_a_bounded_top_k(spark):
    assert "TakeOrderedAndProject" in plan(detection_page(detections(spark, SF)))


def test_score_runs_once_per_row(spark, features):
    from airsleuth.detectors.scores import ReconstructionDetector

    text = plan(ReconstructionDetector().fit(features).predict(features))
    assert text.count("ArrowEvalPython") == 1
