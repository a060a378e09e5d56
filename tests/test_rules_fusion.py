from __future__ import annotations

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from airsleuth.errors import SchemaValidationError
from airsleuth.functions.columns import alert_level, fault_family, known_fault, known_level, or_unknown, severity
from airsleuth.operators.contract import check_contract, to_events
from airsleuth.operators.fusion import annotate, attach_truth, flagged_rows, fuse, lenient_labels, stack
from airsleuth.operators.rules import rule_events, rule_hits
from airsleuth.schema import HIT_COLUMNS
from tests.frames import START, feature_row

CASES = [
    ("steady", {}, None),
    ("valve stuck", {"valve_tracking_err_15_mean": 0.16}, ("VALVE_STUCK", "CRITICAL", "chwc_valve_pct", 2.0)),
    ("valve stuck below", {"valve_tracking_err_15_mean": -0.16}, ("VALVE_STUCK", "CRITICAL", "chwc_valve_pct", 2.0)),
    ("valve at threshold", {"valve_tracking_err_15_mean": 0.08}, None),
    ("damper stuck", {"damper_tracking_err_15_mean": 0.16}, ("DAMPER_STUCK", "CRITICAL", "oa_damper_pct", 2.0)),
    ("coil leakage", {"chwc_valve_pct": 0.01, "temp_supply_celsius": 12.0}, ("COIL_LEAKAGE", "WARNING", "temp_supply_celsius", 2.0)),
    ("leakage, valve open", {"chwc_valve_pct": 0.30, "temp_supply_celsius": 12.0}, None),
    ("leakage at both thresholds", {"chwc_valve_pct": 0.02, "temp_supply_celsius": 13.5}, None),
    ("setpoint bias", {"sa_temp_error_c_60_mean": -2.4, "sa_temp_error_c_60_std": 0.3}, ("SA_SETPOINT_BIAS", "WARNING", "temp_supply_celsius", 2.0)),
    ("oscillation", {"sa_temp_error_c_60_mean": 2.4, "sa_temp_error_c_60_std": 0.8}, None),
    ("fan power", {"sf_power_w": 2000.0}, ("FAN_POWER_ANOMALY", "INFO", "sf_power_w", 10.0)),
    ("fan at three sigmas", {"sf_power_w": 1300.0}, None),
    ("fan without deviation", {"sf_power_w": 9999.0, "sf_power_w_60_std": 0.0}, None),
    ("valve and fan", {"valve_tracking_err_15_mean": 0.16, "sf_power_w": 2000.0}, ("VALVE_STUCK", "CRITICAL", "chwc_valve_pct", 2.0)),
    ("null input", {"valve_tracking_err_15_mean": None}, None),
]


def test_rules(spark):
    rows = spark.createDataFrame([feature_row(i, **values) for i, (_, values, _) in enumerate(CASES)])
    events = {e["event_time"]: e for e in rule_events(rows).collect()}
    for minute, (name, _, expected) in enumerate(CASES):
        event = events.get(START + timedelta(minutes=minute))
        if expected is None:
            assert event is None, name
        else:
            got = (event["violated_policy"], event["alert_level"], event["trigger_signal"], round(event["anomaly_index"], 9))
            assert got == expected, name
            assert event["detector_source"] == "rules" and event["ground_truth"] == "normal"


def test_rule_output_and_repeated_keys(spark):
    rows = [feature_row(0, sf_power_w=2000.0), {**feature_row(0, damper_tracking_err_15_mean=0.2), "row_seq": 5},
            {**feature_row(0, damper_tracking_err_15_mean=0.3), "row_seq": 4}]
    df = spark.createDataFrame(rows)
    events = rule_events(df)
    assert events.columns == ["scenario_file", *HIT_COLUMNS]
    event, = events.collect()
    assert event["violated_policy"] == "DAMPER_STUCK" and event["anomaly_index"] == pytest.approx(0.3 / 0.08)
    assert rule_hits(df).count() == 3
    unlabelled = rule_events(df.drop("fault_type")).first()
    assert unlabelled["ground_truth"] is None
    with pytest.raises(SchemaValidationError):
        rule_events(df.drop("row_seq"))


def _hit(source: str, index: float, policy: str = "P", minute: int = 0, scenario: str = "a.csv") -> tuple:
    return (scenario, START + timedelta(minutes=minute), "zone_1", policy, "INFO", index, "s", source, None)


HIT_SCHEMA = ("scenario_file string, event_time timestamp, zone_id string, violated_policy string, alert_level string, "
              "anomaly_index double, trigger_signal string, detector_source string, ground_truth string")


def test_fuse(spark):
    hits = [_hit("rules", 2.0), _hit("gmm_detector", 5.0), _hit("gmm_detector", 1.0), _hit("rules", 3.0, minute=1),
            _hit("gmm_detector", 3.0, minute=1), _hit("gmm_detector", -1.0, scenario="b.csv")]
    got = {(e["scenario_file"], e["event_time"].minute): e for e in fuse(spark.createDataFrame(hits, HIT_SCHEMA)).collect()}
    assert len(got) == 3
    assert got["a.csv", 0]["anomaly_index"] == 5.0 and got["a.csv", 0]["all_sources"] == "gmm_detector|rules"
    assert got["a.csv", 1]["detector_source"] == "rules"  # ties go to the rules
    assert got["b.csv", 0]["all_sources"] == "gmm_detector"


def test_joins_of_fusion(spark):
    rows = spark.createDataFrame([feature_row(i) for i in range(4)] + [{**feature_row(0, fault="oa_bias"), "row_seq": 99}])
    events = fuse(spark.createDataFrame([_hit("rules", 1.0, scenario="AHU_annual.csv"), _hit("rules", 1.0, minute=9, scenario="AHU_annual.csv")], HIT_SCHEMA))
    assert flagged_rows(rows, events).count() == 2
    truth = {e["event_time"].minute: e["ground_truth"] for e in attach_truth(events, rows).collect()}
    assert truth == {0: "normal", 9: None}
    verdicts = spark.createDataFrame([("AHU_annual.csv", START, "zone_1", "oa_bias", 0.9)],
                                     "scenario_file string, event_time timestamp, zone_id string, predicted_fault string, confidence double")
    noted = {e["event_time"].minute: (e["predicted_fault"], e["confidence"]) for e in annotate(events, verdicts).collect()}
    assert noted == {0: ("oa_bias", 0.9), 9: (None, None)}
    assert stack([events, events]).count() == 4


def test_lenient_labels(spark):
    df = spark.createDataFrame([("x", "oa_bias", "SEVERE"), (None, "y", "CRITICAL")], "ground_truth string, predicted_fault string, alert_level string")
    assert [tuple(r) for r in lenient_labels(df).collect()] == [(None, "oa_bias", "INFO"), (None, None, "CRITICAL")]


def test_levels_and_families(spark):
    df = spark.createDataFrame([(0.8,), (0.79,), (0.5,), (0.49,)], "v double")
    assert [r[0] for r in df.select(alert_level(F.col("v"), 0.5, 0.8)).collect()] == ["CRITICAL", "WARNING", "WARNING", "INFO"]
    words = spark.createDataFrame([("INFO",), ("WARNING",), ("CRITICAL",), ("other",), (None,)], "v string")
    assert [r[0] for r in words.select(severity(F.col("v"))).collect()] == [0, 1, 2, None, None]
    assert [r[0] for r in words.select(known_level(F.col("v"))).collect()] == ["INFO", "WARNING", "CRITICAL", "INFO", "INFO"]
    faults = spark.createDataFrame([("oa_bias",), ("coi_stuck",), ("coi_leakage",), ("normal",)], "v string")
    assert [r[0] for r in faults.select(fault_family(F.col("v"))).collect()] == ["sensor_bias", "actuator_stuck", "actuator_leakage", "unknown"]
    assert [r[0] for r in words.select(known_fault(F.col("v"))).collect()] == [None] * 5
    assert spark.sql("SELECT '' AS v UNION ALL SELECT NULL").select(or_unknown(F.col("v"))).distinct().collect()[0][0] == "unknown"


@pytest.mark.parametrize("change, reason", [
    ({}, None), ({"zone_id": ""}, "zone_id"), ({"zone_id": "z" * 33}, "zone_id"), ({"zone_id": "z" * 32}, None),
    ({"violated_policy": "p" * 65}, "violated_policy"), ({"trigger_signal": None}, "trigger_signal"),
    ({"anomaly_index": -0.1}, "anomaly_index"), ({"anomaly_index": 0.0}, None), ({"anomaly_index": math.nan}, "anomaly_index"),
    ({"alert_level": "SEVERE"}, "alert_level"), ({"ground_truth": "unheard"}, "ground_truth"), ({"ground_truth": None}, None),
    ({"predicted_fault": "unheard"}, "predicted_fault"), ({"confidence": 1.01}, "confidence"), ({"confidence": None}, None),
    ({"confidence": math.nan}, None), ({"event_time": None}, "event_time"),
])
def test_contract(spark, change, reason):
    event = {"event_time": datetime(2024, 6, 1), "zone_id": "ZONE-1", "detector_source": "rules", "violated_policy": "P", "trigger_signal": "s",
             "anomaly_index": 1.5, "alert_level": "INFO", "ground_truth": "normal", "predicted_fault": "oa_bias", "confidence": 0.5, **change}
    schema = ("event_time timestamp, zone_id string, detector_source string, violated_policy string, trigger_signal string, anomaly_index double, "
              "alert_level string, ground_truth string, predicted_fault string, confidence double")
    names = [c.split()[0] for c in schema.split(", ")]
    valid, rejected = check_contract(to_events(spark.createDataFrame([tuple(event[n] for n in names)], schema)))
    assert [r["reason"] for r in rejected.collect()] == ([] if reason is None else [reason])
    assert valid.count() == (reason is None)
