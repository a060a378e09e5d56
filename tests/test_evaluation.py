from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from airsleuth.errors import SchemaValidationError
from airsleuth.functions.quantiles import exact_quantiles
from airsleuth.operators.evaluation import (
    class_report, class_summary, confusion_counts, confusion_matrix, detection_report, fault_recall, label_detections,
    scenario_report, time_to_detect,
)
from airsleuth.operators.splits import (
    contiguous_tail, only_scenario, sample_at_most, sample_for_mixture, sample_per_scenario, split_of, temporal_split, without_scenario,
)
from tests.frames import feature_row


def _detected(spark, rows):
    return spark.createDataFrame(rows, "fault_type string, detected boolean")


def test_detection_report(spark):
    rows = [("coi_bias", True)] * 3 + [("coi_bias", False)] + [("normal", True)] * 2 + [("normal", False)] * 4 + [(None, True)] * 5
    report = detection_report(_detected(spark, rows)).first()
    assert tuple(report) == (10, 5, 0.6, 0.75, 0.6667)
    recall = {r["fault_type"]: r["recall"] for r in fault_recall(_detected(spark, rows)).collect()}
    assert recall == {"coi_bias": 0.75, "coi_leakage": 0.0, "coi_stuck": 0.0, "damper_stuck": 0.0, "oa_bias": 0.0}


def test_detection_report_edges(spark):
    assert tuple(detection_report(_detected(spark, [("normal", False)])).first())[2:] == (0.0, 0.0, 0.0)
    with pytest.raises(Exception, match="no rows with valid"):
        detection_report(_detected(spark, [(None, True)])).collect()
    with pytest.raises(SchemaValidationError, match="detected"):
        detection_report(_detected(spark, [("normal", False)]).drop("detected"))


def test_class_reports(spark):
    pairs = [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("b", "c")] + [(None, "a"), ("b", None)]
    counts = confusion_counts(spark.createDataFrame(pairs, "t string, p string"), "t", "p")
    rows = {r["label"]: tuple(r)[1:] for r in class_report(counts).collect()}
    assert rows == {"a": (1.0, 0.75, 0.8571, 4), "b": (0.6667, 0.6667, 0.6667, 3), "c": (0.0, 0.0, 0.0, 0)}
    assert tuple(class_summary(counts).first()) == (7, 2, 0.7143, 0.5079)
    matrix = {r["truth"]: tuple(r)[1:] for r in confusion_matrix(counts, ["c", "a", "b"]).collect()}
    assert matrix == {"a": (3, 1, 0), "b": (0, 2, 1)}
    with pytest.raises(Exception, match="unexpected label"):
        confusion_matrix(counts, ["a", "b"]).collect()


def test_time_to_detect(spark):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(minutes=10), "coi_bias"), (start + timedelta(minutes=20), "coi_bias"), (start, "oa_bias"), (start, None)]
    events = spark.createDataFrame(rows, "event_time timestamp, ground_truth string")
    starts = {"coi_bias": start, "oa_bias": start + timedelta(minutes=10), "coi_stuck": start}
    assert {r[0]: r[1] for r in time_to_detect(events, starts).collect()} == {"coi_bias": 15.0, "oa_bias": -10.0}


def test_labelled_detections_and_scenarios(spark):
    rows = spark.createDataFrame([feature_row(i) for i in range(4)] + [{**feature_row(i, fault="oa_bias"), "scenario_file": "oa_bias.csv"} for i in range(2)]
                                 + [{**feature_row(i, fault=f), "scenario_file": "mixed.csv"} for i, f in enumerate(["normal", "oa_bias"])])
    events = rows.filter("minute(event_time) = 1").select("scenario_file", "event_time", "zone_id", F.lit("oa_bias").alias("predicted_fault"))
    labelled = label_detections(rows, events.union(events))
    assert labelled.count() == 8
    got = {r["scenario_file"]: (r["kind"], r["n"], r["detected_rows"], r["rate"]) for r in scenario_report(labelled).collect()}
    assert got == {"AHU_annual.csv": ("normal_fpr", 4, 1, 0.25), "oa_bias.csv": ("fault_recall", 2, 1, 0.5), "mixed.csv": ("mixed", 2, 1, None)}
    assert labelled.filter("NOT detected AND predicted_fault = 'normal'").count() == 5


# --- splits and samples -----------------------------------------------------------------


@pytest.mark.parametrize("protocol, text, expected", [
    ("annual", "2018-01-01 00:00:00", "train"), ("annual", "2018-09-30 23:59:59", "train"), ("annual", "2018-09-30 23:59:59.5", "validation"),
    ("annual", "2018-11-30 23:59:59", "validation"), ("annual", "2018-12-01 00:00:00", "final"), ("annual", "2018-12-31 23:59:59.5", None),
    ("annual", "2019-01-01 00:00:00", None), ("common", "2018-03-31 23:59:59", None), ("common", "2018-04-01 00:00:00", "train"),
    ("common", "2018-09-15 00:00:00", "validation"), ("common", "2018-10-31 23:59:59", "final"), ("common", "2018-11-01 00:00:00", None),
])
def test_split_bounds(spark, protocol, text, expected):
    got = spark.range(1).select(split_of(F.lit(text).cast("timestamp"), F.lit(2018), protocol)).first()[0]
    assert got == expected


def test_every_scenario_has_its_own_year(spark):
    rows = [("a", datetime(2018, 5, 1)), ("a", datetime(2019, 5, 1)), ("b", datetime(2020, 5, 1))]
    got = temporal_split(spark.createDataFrame(rows, "scenario_file string, event_time timestamp")).collect()
    assert {(r["scenario_file"], r["event_time"].year): r["split"] for r in got} == {("a", 2018): "train", ("a", 2019): None, ("b", 2020): "train"}
    with pytest.raises(ValueError):
        split_of(F.lit(None), F.lit(2018), "weekly")


def test_hold_out(spark):
    rows = spark.createDataFrame([(s,) for s in ("AHU_annual.csv", "x.csv", "y.csv")], "scenario_file string")
    names = lambda df: sorted(r[0] for r in df.collect())
    assert names(without_scenario(rows, "x.csv")) == ["AHU_annual.csv", "y.csv"]
    assert names(only_scenario(rows, "x.csv")) == ["x.csv"]
    assert names(only_scenario(rows, "x.csv", True)) == ["AHU_annual.csv", "x.csv"]
    assert rows == without_scenario(rows, None) == only_scenario(rows, None)


def test_samples_are_exact_and_repeatable(spark):
    rows = spark.range(3000).selectExpr("id AS row_seq", "CASE WHEN id < 2500 THEN 'hot.csv' ELSE concat('s', id % 3, '.csv') END AS scenario_file")
    take = lambda df: sorted(r["row_seq"] for r in df.collect())
    a = take(sample_at_most(rows, 777, ["row_seq"], 42))
    assert len(a) == 777 and a == take(sample_at_most(rows.repartition(7), 777, ["row_seq"], 42)) and a != take(sample_at_most(rows, 777, ["row_seq"], 43))
    assert len(take(sample_at_most(rows, 5000, ["row_seq"]))) == 3000
    assert len(take(sample_for_mixture(rows, ["row_seq"], above=2999))) == 600
    assert len(take(sample_for_mixture(rows, ["row_seq"], above=3000))) == 3000
    shares = {r[0]: r[1] for r in sample_per_scenario(rows, ["row_seq"]).groupBy("scenario_file").count().collect()}
    assert shares == {"hot.csv": 500, "s0.csv": 33, "s1.csv": 33, "s2.csv": 33}


@pytest.mark.parametrize("max_rows", [7, 1000])
def test_tail(spark, max_rows):
    rows = spark.createDataFrame([{**feature_row(i), "zone_id": z} for z, n in (("zone_1", 50), ("zone_2", 7)) for i in range(n)])
    got = contiguous_tail(rows, max_rows=max_rows).groupBy("zone_id").agg(F.count("*").alias("n"), F.min("row_seq").alias("first")).collect()
    assert {r["zone_id"]: (r["n"], r["first"]) for r in got} == {"zone_1": (10, 40), "zone_2": (2, 5)}


@pytest.mark.parametrize("accuracy", [50, 10_000])
def test_exact_quantiles(spark, accuracy):
    random = np.random.default_rng(0)
    values = np.concatenate([random.normal(0, 1, 2000), np.full(1500, 0.25), random.exponential(5, 700).round(1)])
    df = spark.createDataFrame([(float(v),) for v in values], "v double").union(spark.sql("SELECT CAST(NULL AS DOUBLE)"))
    wanted = [0.0, 0.05, 0.5, 0.9, 0.95, 0.999, 1.0]
    np.testing.assert_allclose(exact_quantiles(df, "v", wanted, accuracy), np.quantile(values, wanted), atol=1e-12)
    assert exact_quantiles(df.filter("v > 1e9"), "v", [0.5]) is None
