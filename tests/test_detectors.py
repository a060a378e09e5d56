from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from airsleuth.catalog import QUERIES as learned_queries
from airsleuth.catalog import learned
from airsleuth.detectors.backends import balanced, cascade_probabilities, class_weights
from airsleuth.detectors.base import RuleDetector, calibrated_threshold
from airsleuth.detectors.boosting import ROUNDS
from airsleuth.detectors.classifier import FaultClassifier, fault_hits, verdict
from airsleuth.detectors.scores import IsolationForestDetector, MixtureDetector, ReconstructionDetector
from airsleuth.errors import DetectorNotFittedError
from airsleuth.operators.evaluation import class_summary, confusion_counts
from airsleuth.operators.splits import normal_rows
from airsleuth.plans.detection import detect, evaluate, fault_scenarios, split_rows, store, train_classifier
from airsleuth.plans.hold_out import hold_out_gaussian_summary, hold_out_summary, held_out_gaussians
from airsleuth.schema import CLASSIFIED_COLUMNS, FAULT_TYPES, FEATURES, HIT_COLUMNS, NORMAL
from airsleuth.session import cut_lineage
from tests.frames import separable_frame

CLASSES = sorted(FAULT_TYPES)


@pytest.fixture(scope="module")
def rows(spark):
    return cut_lineage(spark.createDataFrame(separable_frame()))


DETECTORS = [
    (lambda: MixtureDetector(components=2, max_iter=20), 0.10), (lambda: MixtureDetector(components=1, covariance="diag"), 0.10),
    *[(lambda kind=kind: MixtureDetector(components=2, covariance=kind, max_iter=5), 0.10) for kind in ("tied", "diag", "spherical")],
    (lambda: IsolationForestDetector(trees=30), 0.05), (ReconstructionDetector, 0.05),
]


@pytest.mark.parametrize("make, share", DETECTORS)
def test_score_detectors(spark, rows, tmp_path, make, share):
    detector = make()
    for use in (lambda: detector.predict(rows), lambda: detector.save(spark, str(tmp_path / "early"))):
        with pytest.raises(DetectorNotFittedError):
            use()
    detector.fit(rows)
    hits = detector.predict(rows)
    assert hits.columns == ["scenario_file", *HIT_COLUMNS]
    normals = normal_rows(rows)
    assert detector.predict(normals).count() == pytest.approx(share * 100, abs=1)
    # each fault shifts but two of 31 features, which a forest of random splits sees least
    found = hits.filter("scenario_file <> 'normal.csv'").count()
    assert found > (50 if isinstance(detector, IsolationForestDetector) else 400)
    assert detector.critical >= detector.warning
    levels = {r["alert_level"]: r["m"] for r in hits.groupBy("alert_level").agg(F.min("anomaly_index").alias("m")).collect()}
    assert levels["CRITICAL"] >= detector.critical
    detector.save(spark, str(tmp_path / "model"))
    again = type(detector).load(spark, str(tmp_path / "model"))
    key = ["scenario_file", "event_time", "anomaly_index", "alert_level"]
    pd.testing.assert_frame_equal(*[d.predict(rows).select(key).toPandas().sort_values(key).reset_index(drop=True) for d in (detector, again)])


def test_incomplete_rows_are_not_scored(spark, rows):
    detector = MixtureDetector(components=1, covariance="diag").fit(rows)
    broken = rows.withColumn("oa_damper_pct_lag1", F.when(F.col("row_seq") >= 5, F.col("oa_damper_pct_lag1")))
    assert detector.score(broken).count() == 600 - 6 * 5


def test_mixture_score_is_the_likelihood(spark, rows):
    detector = MixtureDetector(components=1, max_iter=5).fit(rows)
    scored = detector.score(normal_rows(rows)).select(*FEATURES, "score").toPandas()
    x = detector.scaler.batch(scored[FEATURES])
    cov = np.cov(x.T, bias=True) + detector.RIDGE * np.eye(len(FEATURES))
    d = x - x.mean(axis=0)
    expected = 0.5 * ((d @ np.linalg.inv(cov) * d).sum(axis=1) + np.linalg.slogdet(cov)[1] + len(FEATURES) * np.log(2 * np.pi))
    np.testing.assert_allclose(scored["score"], expected, rtol=1e-6)


@pytest.mark.parametrize("make", [d for d, _ in DETECTORS])
def test_calibrated_rate_keeps_the_target(rows, make):
    detector = make().fit(rows)
    if isinstance(detector, IsolationForestDetector):
        with pytest.raises(ValueError):
            detector.calibrate(rows, 0.0)
        return
    detector.calibrate(rows, 0.2)
    assert detector.predict(normal_rows(rows)).count() / 100 <= 0.2 + 0.01
    for wrong in (0.0, 1.0, -1.0):
        with pytest.raises(ValueError):
            detector.calibrate(rows, wrong)
    with pytest.raises(ValueError, match="no complete normal rows"):
        detector.calibrate(rows.filter(f"fault_type <> '{NORMAL}'"), 0.1)


def test_mixture_options():
    for wrong in ({"covariance": "tied"}, {"covariance": "diag", "components": 3}):
        with pytest.raises(ValueError):
            MixtureDetector(**wrong)


def _parts(rows):
    """A shuffled quarter for testing; the rest for training."""
    number = F.pmod(F.xxhash64("scenario_file", "row_seq"), F.lit(4))
    return rows.filter(number != 0), rows.filter(number == 0)


BACKENDS = [("random_forest", {"numTrees": 20, "maxDepth": 6}), ("boosted", {"rounds": 20}), ("cascade", {"rounds": 20}), ("neural", {"maxIter": 60}), ("graph", {"maxIter": 60})]


@pytest.mark.parametrize("backend, options", BACKENDS)
def test_classifiers_on_separable_classes(spark, rows, tmp_path, backend, options):
    train, test = _parts(rows)
    classifier = FaultClassifier(backend, **options)
    with pytest.raises(DetectorNotFittedError):
        classifier.predict(test)
    classifier.fit(train)
    judged = classifier.judge(test)
    assert class_summary(confusion_counts(judged, "fault_type", "predicted_fault")).first()["macro_f1"] > 0.80
    sums = judged.select(F.aggregate("probability", F.lit(0.0), lambda a, b: a + b).alias("s"), "confidence", "score")
    assert sums.filter("abs(s - 1) > 1e-9 OR confidence NOT BETWEEN 0 AND 1.000001 OR score NOT BETWEEN -0.000001 AND 1.000001").count() == 0
    hits = classifier.predict(test)
    assert hits.columns == ["scenario_file", *CLASSIFIED_COLUMNS]
    assert hits.filter(f"predicted_fault = '{NORMAL}' OR violated_policy <> predicted_fault").count() == 0
    classifier.calibrate(rows, 0.1)
    assert classifier.predict(normal_rows(rows)).count() / 100 <= 0.11
    classifier.save(spark, str(tmp_path / "model"))
    again = FaultClassifier.load(spark, str(tmp_path / "model"))
    key = ["scenario_file", "row_seq", "predicted_fault", "confidence"]
    pd.testing.assert_frame_equal(*[c.judge(test).select(key).toPandas().sort_values(key).reset_index(drop=True) for c in (classifier, again)])


@pytest.mark.parametrize("name", ["d5_random_forest", "d6_boosted_trees", "d9_cascade", "d10_sequence", "d11_neural", "d11_graph", "d13_fused_run", "d14_classifier_only"])
def test_queries_train_the_default_models(spark, monkeypatch, name):
    class Asked(Exception):
        pass

    def ask(split, classifier):
        raise Asked(classifier)

    monkeypatch.setattr(learned, "_run", lambda *_: (None, None))
    monkeypatch.setattr(learned, "split_rows", lambda *_: None)
    monkeypatch.setattr(learned, "train_unsupervised", lambda *_, **__: None)
    monkeypatch.setattr(learned, "train_classifier", ask)
    with pytest.raises(Asked) as asked:
        learned_queries[name](spark, "")
    assert asked.value.args[0].backend.options == {}


def test_saved_models_are_of_every_kind_and_size(spark):
    kinds = learned.every_kind()
    assert len({getattr(d, "backend", d).__class__ for d in kinds}) == 9
    assert [d.trees for d in kinds if isinstance(d, IsolationForestDetector)] == [100]
    assert ROUNDS == 200  # a fixed value


def test_sequence_classifier(spark, rows):
    classifier = FaultClassifier("sequence", maxIter=60).fit(rows)
    judged = classifier.judge(rows)
    assert judged.count() == 600  # rows before the first whole window get its verdict
    assert class_summary(confusion_counts(judged, "fault_type", "predicted_fault")).first()["macro_f1"] > 0.80
    heads = judged.filter("row_seq < 30").groupBy("scenario_file").agg(F.count_distinct("confidence").alias("n")).collect()
    assert [r["n"] for r in heads] == [1] * 6
    short = judged.select(*rows.columns).filter("row_seq < 10")
    assert {r["n"] for r in classifier.judge(short).groupBy("scenario_file").agg(F.count_distinct("confidence").alias("n")).collect()} == {1}
    with pytest.raises(ValueError, match="no complete sequence window"):
        FaultClassifier("sequence").fit(rows.filter("row_seq < 20"))


def test_classifier_needs_normal_rows(rows):
    with pytest.raises(ValueError, match="normal"):
        FaultClassifier("random_forest").fit(rows.filter("fault_type <> 'normal'"))
    with pytest.raises(ValueError, match="oracle"):
        FaultClassifier("oracle")


def test_verdict_and_threshold(spark):
    p = [[0.1, 0.1, 0.1, 0.1, 0.5, 0.1], [0.45, 0.0, 0.0, 0.0, 0.35, 0.2], [0.3, 0.0, 0.0, 0.0, 0.29, 0.41], [0.0, 0.0, 0.9, 0.0, 0.1, 0.0]]
    rows = spark.createDataFrame([("s", None, f"z{i}", v) for i, v in enumerate(p)], "scenario_file string, event_time timestamp, zone_id string, probability array<double>")
    judged = verdict(rows, CLASSES)
    assert [r["predicted_fault"] for r in judged.orderBy("zone_id").collect()] == ["normal", "coi_bias", "oa_bias", "coi_stuck"]
    assert {r["zone_id"]: r["alert_level"] for r in fault_hits(judged).collect()} == {"z1": "INFO", "z2": "INFO", "z3": "CRITICAL"}
    assert sorted(r["zone_id"] for r in fault_hits(judged, 0.7).collect()) == ["z2", "z3"]
    assert calibrated_threshold(judged, 0.5) == pytest.approx(0.68)
    with pytest.raises(ValueError):
        verdict(rows, ["a", "b"])


def test_cascade_products(spark):
    p = cascade_probabilities(F.lit(0.8), F.array(F.lit(0.5), F.lit(0.25), F.lit(0.25)), F.lit(0.25), F.lit(0.5), CLASSES)
    got = dict(zip(CLASSES, spark.range(1).select(p).first()[0]))
    assert got == pytest.approx({"normal": 0.2, "coi_bias": 0.3, "oa_bias": 0.1, "coi_stuck": 0.1, "damper_stuck": 0.1, "coi_leakage": 0.2})
    none = cascade_probabilities(F.lit(1.0), F.lit(None).cast("array<double>"), F.lit(0.5), F.lit(0.5), CLASSES)
    assert spark.range(1).select(none).first()[0] == [0.0] * 6


def test_balanced_classes(spark):
    rows = spark.range(1000).selectExpr("id AS row_seq", "CASE WHEN id < 900 THEN 'normal' ELSE 'oa_bias' END AS fault_type")
    weights = class_weights(rows)
    assert weights == pytest.approx({"normal": 1000 / 1800, "oa_bias": 5.0})
    sizes = {r[0]: r[1] for r in balanced(rows, weights, ["row_seq"]).groupBy("fault_type").count().collect()}
    assert sizes["oa_bias"] == 500 and sizes["normal"] == pytest.approx(500, abs=50)


# --- whole runs -------------------------------------------------------------------------


def test_run_from_split_to_store(spark, features, tmp_path):
    split = split_rows(features)
    gaussian = MixtureDetector(components=1, covariance="diag").fit(split.train)
    classifier = train_classifier(split, FaultClassifier("random_forest", numTrees=10, maxDepth=5))
    events = cut_lineage(detect(split.evaluation, [RuleDetector(), gaussian], classifier))
    keys = events.select("scenario_file", "event_time", "zone_id")
    assert keys.count() == keys.distinct().count() > 0
    assert events.filter("ground_truth IS NULL").count() == 0
    alone = detect(split.evaluation, [], classifier)
    assert set(CLASSIFIED_COLUMNS) <= set(alone.columns)
    with pytest.raises(ValueError):
        detect(split.evaluation, [])
    reports = evaluate(split.evaluation, events, used_classifier=True)
    assert reports.overall.first()["n_evaluated"] == split.evaluation.count()
    assert reports.per_fault.count() == 5 and reports.per_scenario.count() == 10
    assert reports.bursts.agg(F.sum("rows")).first()[0] == events.count()
    assert reports.summary.first()["n_evaluated"] == split.evaluation.count() and reports.classes.count() >= 2
    written, rejected = store(events, str(tmp_path / "events"))
    assert written + rejected.count() == events.count()
    assert rejected.filter("reason <> 'anomaly_index'").count() == 0


def test_hold_out_summary(spark, features):
    names = fault_scenarios(features)
    assert len(names) == 9
    seen = []

    def rules_only(split):
        seen.append(sorted(r[0] for r in split.train.select("scenario_file").distinct().collect()))
        return detect(split.evaluation, [RuleDetector()])

    summary = hold_out_summary(features, names[:2], rules_only, "rules").toPandas()
    assert summary["scenario"].tolist() == names[:2] and summary["normal_reference_fpr"].notna().all()
    assert all(name not in used and len(used) == 9 for name, used in zip(names, seen))
    with pytest.raises(ValueError):
        split_rows(features, window="train")


def test_held_out_gaussians_equal_refits(spark, rows):
    """Also where the held-out scenario has normal rows, and where a feature varies only there."""
    lag = FEATURES[0]
    several = rows.withColumn("scenario_file", F.when(F.col("fault_type") != NORMAL, F.col("scenario_file")).otherwise(
        F.concat(F.lit("normal_"), (F.unix_micros("event_time") / 60_000_000 % 3).cast("int").cast("string"))))
    several = cut_lineage(several.withColumn(lag, F.when(F.col("scenario_file") == "normal_1", F.col(lag) * 7 + 3).when(
        F.col("fault_type") == NORMAL, F.lit(4.0)).otherwise(F.col(lag))))
    fault = fault_scenarios(several)[0]
    names = ["normal_0", "normal_1", fault]
    found = held_out_gaussians(several, names)
    assert found.keys() == set(names)
    for name in names:
        again = MixtureDetector(components=1, covariance="diag").fit(several.filter(F.col("scenario_file") != name))
        assert found[name].scaler.means == pytest.approx(again.scaler.means, rel=1e-9, abs=1e-9)
        assert found[name].scaler.stds == pytest.approx(again.scaler.stds, rel=1e-7)
        assert (found[name].warning, found[name].critical) == pytest.approx((again.warning, again.critical), rel=1e-7)


def test_hold_outs_without_refits_equal_refits(spark, features):
    names = fault_scenarios(features)[:3]

    def anew(split):
        return detect(split.evaluation, [RuleDetector(), MixtureDetector(components=1, covariance="diag").fit(split.train)])

    one, each = (d.toPandas().sort_values("scenario").reset_index(drop=True) for d in (
        hold_out_gaussian_summary(features, names), hold_out_summary(features, names, anew, "rules_gmm")))
    pd.testing.assert_frame_equal(one, each)
    assert one["classification_accuracy"].isna().all() and one["normal_reference_fpr"].notna().all()


def test_hold_outs_with_a_classifier(spark, features):
    names = fault_scenarios(features)[:1]

    def forest(split):
        return detect(split.evaluation, [], train_classifier(split, FaultClassifier("random_forest", numTrees=5, maxDepth=4)))

    summary = hold_out_summary(features, names, forest, "forest", used_classifier=True).first()
    split = split_rows(features, "common", "final", names[0], with_normal_reference=True)
    reports = evaluate(split.evaluation, forest(split), used_classifier=True)
    overall, classes = reports.overall.first(), reports.summary.first()
    assert (summary.n_evaluated, summary.detection_f1) == (overall.n_evaluated, overall.f1)
    assert (summary.classification_accuracy, summary.classification_macro_f1) == (classes.accuracy, classes.macro_f1)
