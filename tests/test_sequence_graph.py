"""Convolutions over windows by plain loops, and the graph on planted groups of signals."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from airsleuth.detectors.backends import GraphBackend
from airsleuth.detectors.classifier import FaultClassifier
from airsleuth.detectors.convolution import TAPS, Kernels, responses, rows_back
from airsleuth.detectors.graph import adjacency, sparse_inverse
from airsleuth.detectors.runs import COUNT, counted_series
from airsleuth.plans.detection import training_sample
from airsleuth.schema import FAULT_TYPES, FEATURES
from airsleuth.session import cut_lineage
from tests.frames import separable_frame


@pytest.fixture(scope="module")
def rows(spark):
    return cut_lineage(spark.createDataFrame(separable_frame()))


def test_responses_by_plain_loops():
    draw = np.random.default_rng(0)
    values, group = draw.normal(size=(75, 5)), np.repeat([7, 3, 9], [40, 5, 30])
    kernels = Kernels.drawn(5, 1, 8)
    got = responses(values, group, kernels)
    for i in range(len(values)):
        first = int(np.flatnonzero(group == group[i])[0])
        window = [values[max(i - o, first)] for o in range(29, -1, -1)]
        for k in range(8):
            d, found = int(kernels.dilation[k]), []
            for t in range((TAPS - 1) * d, 30):
                found.append(sum(window[t - j * d][s] * kernels.weights[k, j, n] for j in range(TAPS) for n, s in enumerate(kernels.signals[k])))
            assert got[i, 2 * k] == pytest.approx(max(found)) and got[i, 2 * k + 1] == pytest.approx(np.mean(np.array(found) > kernels.threshold[k]))
    assert rows_back(np.zeros(0, int)).shape == (0, 30)


def test_order_of_rows_inside_the_window_counts(spark, rows):
    """The same rows in another order before the last one give another verdict at the last one."""
    classifier = FaultClassifier("sequence", maxIter=40).fit(rows)
    series = rows.filter("scenario_file = 'coi_bias.csv' AND row_seq < 30")
    turned = series.withColumn("row_seq", F.when(F.col("row_seq") < 29, 28 - F.col("row_seq")).otherwise(F.col("row_seq")))
    at = "row_seq"
    stretched = turned.withColumn("event_time", F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col(at) * 60_000_000))
    same = series.withColumn("event_time", F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col(at) * 60_000_000))
    last = [classifier.judge(df).filter("row_seq = 29").first()["probability"] for df in (same, stretched)]
    assert not np.allclose(last[0], last[1])
    plan = classifier.judge(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def _groups(n: int = 4000) -> np.ndarray:
    """Three groups of signals that each follow a signal of their own, and two alone."""
    draw = np.random.default_rng(3)
    hidden = draw.normal(size=(n, 3))
    return np.column_stack([hidden[:, [0, 0, 0, 1, 1, 2, 2, 2]] + 0.5 * draw.normal(size=(n, 8)), draw.normal(size=(n, 2))])


def test_graph_finds_planted_groups():
    weights = adjacency(np.corrcoef(_groups().T))
    member = [0, 0, 0, 1, 1, 2, 2, 2, 3, 4]
    for i in range(10):
        for j in range(10):
            assert (weights[i, j] > 0) == (member[i] == member[j] and (i != j or member.count(member[i]) == 1)), (i, j)
    assert np.allclose(weights.sum(axis=1), 1)


def test_sparse_inverse_meets_its_optimality_conditions():
    covariance = np.corrcoef(_groups().T)
    inverse = sparse_inverse(covariance, 0.05, tolerance=1e-9)
    rest = np.linalg.inv(inverse) - covariance
    zero = np.abs(inverse) < 1e-9
    assert np.abs(rest).max() <= 0.05 + 1e-4 and np.allclose(rest[~zero], 0.05 * np.sign(inverse[~zero]), atol=1e-4)
    assert np.allclose(sparse_inverse(covariance, 0.0, tolerance=1e-10), np.linalg.inv(covariance), atol=1e-4)


def test_graph_is_saved_with_the_model(spark, rows, tmp_path):
    classifier = FaultClassifier("graph", maxIter=5).fit(rows)
    classifier.save(spark, str(tmp_path / "graph"))
    again = FaultClassifier.load(spark, str(tmp_path / "graph")).backend
    assert isinstance(again, GraphBackend) and again.adjacency == classifier.backend.adjacency
    assert np.array(again.adjacency).shape == (len(FEATURES), len(FEATURES))


def test_responses_slide_over_each_row_once():
    """The same as from windows laid out row by row, in memory that does not grow with the window."""
    draw = np.random.default_rng(5)
    values, group = draw.normal(size=(20_000, 6)), np.repeat([7, 3, 9, 1, 7], [1, 40, 29, 30, 19_900])
    kernels = Kernels.drawn(6, 2, 8)
    tracemalloc.start()
    got = responses(values, group, kernels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25 * got[:, :1].nbytes + got.nbytes
    back = rows_back(group)
    for k, (signals, weights, dilation, threshold) in enumerate(zip(*kernels)):
        taps = values[:, signals] @ weights.T
        places = back.shape[1] - (TAPS - 1) * dilation
        laid = sum(taps[back[:, j * dilation:j * dilation + places], j] for j in range(TAPS))
        assert (got[:, 2 * k] == laid.max(axis=1)).all() and (got[:, 2 * k + 1] == (laid > threshold).mean(axis=1)).all()


def test_sequence_models_learn_from_all_rows_unless_a_share_is_asked_for(rows):
    assert training_sample(rows, "sequence").count() == rows.count() == 600
    assert training_sample(rows, "sequence", 0.2).count() == 120


def test_equal_series_are_computed_once_and_counted(rows):
    """Zones with the same rows stand for each other, also without a name; a zone with another value or fewer rows does not."""
    third = rows.withColumn("zone_id", F.lit("zone_3")).withColumn(FEATURES[0], F.when(F.col("row_seq") == 50, 9.0).otherwise(F.col(FEATURES[0])))
    zones = rows.unionByName(rows.withColumn("zone_id", F.lit(None).cast("string"))).unionByName(third)
    zones = cut_lineage(zones.unionByName(rows.filter("row_seq < 99").withColumn("zone_id", F.lit("zone_4"))))
    found = counted_series(zones, ["fault_type", *FEATURES])
    got = {(r.scenario_file, r[COUNT], r.n) for r in found.groupBy("scenario_file", "zone_id", COUNT).agg(F.count("*").alias("n")).collect()}
    assert got == {(f"{f}.csv", c, n) for f in FAULT_TYPES for c, n in ((2, 100), (1, 100), (1, 99))}
    assert found.agg(F.sum(COUNT)).first()[0] == zones.count()


def test_a_sequence_head_weighs_classes_and_copies(rows):
    """Copies of all series change nothing; every window counts, however few its class has."""
    few = cut_lineage(rows.filter("fault_type = 'normal' OR row_seq < 45"))
    copies = cut_lineage(few.unionByName(few.withColumn("zone_id", F.lit("zone_2"))))
    once, twice = (FaultClassifier("sequence", maxIter=30).fit(r).backend.model.coefficientMatrix.toArray() for r in (few, copies))
    assert np.allclose(once, twice, atol=1e-6)
