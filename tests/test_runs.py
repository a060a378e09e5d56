"""Runs of equal rows: counted tables and results for each row."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from airsleuth.catalog import learned
from airsleuth.catalog.base import features as all_features
from airsleuth.detectors.classifier import FaultClassifier
from airsleuth.detectors.mixture import fit_mixture, start
from airsleuth.detectors.runs import COUNT, counted_runs, fewest_copies, for_each_run, run_lengths, run_starts
from airsleuth.detectors.scores import Scaler, covariance
from airsleuth.detectors.sums import summed
from airsleuth.schema import FEATURES, NORMAL
from airsleuth.session import cut_lineage
from tests.frames import separable_frame


def _zones(spark, frame: pd.DataFrame, copies: int):
    """Each row ``copies`` times, one after the other, in two tasks."""
    return cut_lineage(spark.createDataFrame(frame).repartition(2).withColumn(
        "zone_id", F.explode(F.array(*[F.lit(f"zone_{k}") for k in range(copies)]))))


def test_runs_begin_where_rows_differ():
    starts = run_starts([np.array([1.0, 1.0, 2.0, np.nan, np.nan]), np.array(["a", "a", "a", None, None], object)])
    assert starts.tolist() == [True, False, True, True, True]
    assert run_lengths(starts).tolist() == [2, 1, 1, 1] and run_starts([np.zeros(0)]).tolist() == []
    seen = []
    got = for_each_run(np.array([[1.0], [1.0], [3.0], [1.0]]), lambda x: seen.append(len(x)) or x[:, 0] * 2)
    assert got.tolist() == [2, 2, 6, 2] and seen == [3]


def test_counted_rows_are_all_rows(spark):
    """Also where a run goes on in the next batch, with nulls and copies that lie apart."""
    rows = spark.range(0, 60, 1, 1).select((F.floor(F.col("id") / 7) % 3).cast("double").alias("a"),
                                           F.when(F.col("id") % 21 < 14, F.lit("x")).alias("b"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        counted = counted_runs(rows, ["a", "b"]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(counted) == 9
    total = {}
    for r in counted:
        total[r.a, r.b] = total.get((r.a, r.b), 0) + r[COUNT]
    assert total == {(r.a, r.b): r["count"] for r in rows.groupBy("a", "b").count().collect()}


def test_fewest_copies_keep_the_shares(spark):
    counted = spark.createDataFrame([("a", 10), ("b", 5), ("c", 15)], f"v string, {COUNT} long")
    assert sorted(r.v for r in fewest_copies(counted).collect()) == ["a", "a", "b", "c", "c", "c"]
    assert fewest_copies(counted.withColumn(COUNT, F.lit(5).cast("long"))).count() == 3


def test_sums_and_mixtures_of_counted_rows_are_those_of_all(spark):
    frame = separable_frame(40)
    rows = _zones(spark, frame[frame["fault_type"] == NORMAL], 5)
    counted = cut_lineage(counted_runs(rows, FEATURES))
    assert counted.count() == 40
    scaler = Scaler.of(rows)
    assert np.allclose(covariance(rows, scaler), covariance(counted, scaler))
    assert summed(counted, lambda x, n: n.sum(), (1,)).tolist() == [200]
    first = start(scaler.batch(counted.select(*FEATURES).toPandas()), 2, "full", 1)
    for a, b in zip(*(fit_mixture(t, scaler.batch, first, "full", 1e-2, 3) for t in (rows, counted))):
        assert np.allclose(a, b, atol=1e-9)


@pytest.mark.parametrize("backend", ["neural", "graph"])
def test_networks_train_on_rows_once(spark, monkeypatch, backend):
    """The network sees 120 of 600 equal rows, with the loss and so the verdicts of all."""
    seen = []
    real = FaultClassifier(backend).backend.__class__._scaled
    monkeypatch.setattr(FaultClassifier(backend).backend.__class__, "_scaled", lambda self, rows: (seen.append(rows), real(self, rows))[1])
    rows = _zones(spark, separable_frame(20), 5)
    classifier = FaultClassifier(backend, maxIter=40).fit(rows)
    assert seen[0].count() == 120
    judged = classifier.judge(rows)
    assert judged.count() == 600 and judged.filter("predicted_fault = fault_type").count() > 480


def test_training_features_are_written_before_they_are_copied_to_zones(spark, monkeypatch):
    """A fifth of the rows is written, and the rows are those of the features."""
    sizes = []
    monkeypatch.setattr(learned, "cut_lineage", lambda df: (written := cut_lineage(df), sizes.append(written.count()))[0])
    rows = learned.kept_features(spark, "/root/testdata/sf0.001")
    whole = all_features(spark, "/root/testdata/sf0.001")
    assert rows.dtypes == whole.dtypes and sizes == [whole.count() / 5]
    assert rows.exceptAll(whole).isEmpty() and whole.exceptAll(rows).isEmpty()


def test_runs_go_on_from_batch_to_batch(spark):
    """Runs longer than a batch, of nulls and NaN too, and what networks write: equal rows once, nothing in zones."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        values = [("a", 1.0)] * 11 + [("b", 1.0)] * 2 + [(None, 2.0)] * 6 + [("b", 2.0)]
        counted = counted_runs(spark.createDataFrame(values, "l string, x double").coalesce(1), ["x", "l"])
        assert [tuple(r) for r in counted.collect()] == [(1.0, "a", 11), (1.0, "b", 2), (2.0, None, 6), (2.0, "b", 1)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_networks_write_equal_rows_once(spark):
    rows = spark.createDataFrame([(1.0 * (i // 5), "normal") for i in range(40)], "x double, fault_type string").coalesce(1)
    rows = rows.select(*[F.col("x").alias(c) for c in FEATURES], "fault_type")
    kept = FaultClassifier("graph").backend.kept(rows)
    assert kept.count() == 8 and kept.agg(F.sum(COUNT)).first()[0] == 40
