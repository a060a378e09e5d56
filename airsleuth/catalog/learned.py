"""Queries of learned detectors, their thresholds and whole runs.

Models of MLlib have no SQL twin; for each kind there is one that has: a
Gaussian with a closed form, and verdicts on probabilities derived from rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airsleuth.catalog.base import (
    DETECTIONS, FEATURE_ROWS, HITS, LONG, detections, features, long, query, r6, rounded, wide, with_sql,
)
from airsleuth.catalog.events import HIT_SQL, shown
from airsleuth.catalog.ingest import ANNUAL, COMMON
from airsleuth.detectors.backends import BACKENDS, Backend, cascade_probabilities, class_weights, label_index
from airsleuth.detectors.base import Detector, RuleDetector, calibrated_threshold
from airsleuth.detectors.classifier import FaultClassifier, fault_hits, verdict
from airsleuth.detectors.scores import IsolationForestDetector, MixtureDetector, ReconstructionDetector, Scaler
from airsleuth.functions.quantiles import exact_quantiles
from airsleuth.operators.evaluation import label_detections, round4, scenario_report
from airsleuth.operators.features import wide_features
from airsleuth.operators.fusion import stack
from airsleuth.operators.reshape import copy_to_zones
from airsleuth.operators.splits import complete_rows, normal_rows
from airsleuth.plans.detection import Split, detect, fault_scenarios, split_rows, train_classifier, train_unsupervised
from airsleuth.plans.hold_out import hold_out_gaussian_summary, hold_out_summary
from airsleuth.schema import FAULT_TYPES, FEATURES, NORMAL, RUN_COLUMNS, SCENARIO, SEQ, ZONE_COLUMNS
from airsleuth.session import cut_lineage, scratch_path

CLASSES = sorted(FAULT_TYPES)
_WHOLE = " AND ".join(f"{c} IS NOT NULL" for c in FEATURES)
ROW = "scenario_file, zone_id, row_seq"


def kept_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features as a written table, as training reads them many times; copied to the zones as they are read."""
    return copy_to_zones(cut_lineage(wide_features(wide(spark, sf_dir))))


def run_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``kept_features`` with what rules, detectors and their evaluation read, so that nothing else is sorted and written."""
    keep = [*RUN_COLUMNS, *ZONE_COLUMNS]
    return copy_to_zones(cut_lineage(wide_features(wide(spark, sf_dir), keep=keep)))


# --- scaling, encoding, quantiles ---------------------------------------------------

_SCALED = ["valve_tracking_err", "sa_temp_error_c_60_mean", "sf_power_w_60_mean"]


@query("p25_standardized", with_sql(FEATURE_ROWS, f"""
SELECT {ROW}, {', '.join(r6(f'({c} - m_{c}) / s_{c}', c, 5) for c in _SCALED)} FROM (SELECT * FROM features WHERE {_WHOLE} AND fault_type = 'normal'),
  (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in _SCALED)} FROM features WHERE {_WHOLE} AND fault_type = 'normal')"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    normals = complete_rows(normal_rows(features(spark, sf_dir)))
    scaled = dict(zip(FEATURES, Scaler.of(normals).columns()))
    out = normals.select(SCENARIO, "zone_id", SEQ, *[scaled[c].alias(c) for c in _SCALED])
    return rounded(out, *_SCALED, digits=5)


@query("p26_label_index", with_sql(LONG, f"SELECT {ROW}, (dense_rank() OVER (ORDER BY fault_type) - 1)::DOUBLE AS label FROM long"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(spark, sf_dir).select(SCENARIO, "zone_id", SEQ, label_index(F.col("fault_type"), CLASSES).alias("label"))


@query("a5_exact_percentiles", """
SELECT quantile_cont(l_extendedprice, 0.90) AS p90, quantile_cont(l_extendedprice, 0.95) AS p95, quantile_cont(l_extendedprice, 0.99) AS p99 FROM lineitem""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    p90, p95, p99 = exact_quantiles(items, "l_extendedprice", [0.90, 0.95, 0.99])
    return spark.range(1).select(F.lit(p90).alias("p90"), F.lit(p95).alias("p95"), F.lit(p99).alias("p99"))


@query("a6_calibrated_threshold", with_sql(DETECTIONS, """
SELECT quantile_cont(anomaly_index, 0.9) AS threshold FROM detections WHERE ground_truth = 'normal'"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    normals = detections(spark, sf_dir).filter(F.col("ground_truth") == NORMAL)
    return spark.range(1).select(F.lit(calibrated_threshold(normals.select(F.col("anomaly_index").alias("score")), 0.1)).alias("threshold"))


@query("a14_class_weights", with_sql(LONG, """
SELECT fault_type, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM long GROUP BY fault_type"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = long(spark, sf_dir)
    weights = class_weights(rows)
    weight = F.create_map(*[F.lit(v) for pair in weights.items() for v in pair])[F.col("fault_type")]
    return rows.groupBy("fault_type").agg(F.count("*").alias("n")).withColumn("weight", F.round(weight, 6))


@query("p29_four_digits", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN NULL ELSE round(l_extendedprice / 7 + 1.2345e-7, 4) END AS value FROM lineitem""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NaN is kept by the rounding, and becomes null at the end for the comparison only."""
    value = F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).otherwise(F.col("l_extendedprice") / 7 + 1.2345e-7)
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return items.select("l_orderkey", "l_linenumber", F.nullif(round4(value), F.lit(float("nan"))).alias("value"))


# --- verdicts on derived probabilities ----------------------------------------------


def _weights() -> list[Column]:
    return [1 + (F.col(SEQ) * (7 + 2 * i) + 13 * i) % 16 + F.when(F.col("fault_type") == c, 40).otherwise(0) for i, c in enumerate(CLASSES)]


def _probable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with class probabilities that favour the true class."""
    return long(spark, sf_dir).withColumn("probability", _derived())


def _derived() -> Column:
    total = sum(_weights()[1:], _weights()[0])
    return F.array(*[w / total for w in _weights()])


_W = [f"(1 + (row_seq * {7 + 2 * i} + {13 * i}) % 16 + CASE WHEN fault_type = '{c}' THEN 40 ELSE 0 END)" for i, c in enumerate(CLASSES)]
JUDGED = LONG + f""",
probable AS (SELECT *, list_transform([{', '.join(_W)}], lambda w: w / ({' + '.join(_W)})) AS p FROM long),
judged AS (
  SELECT *, list_max(p) AS confidence, {CLASSES}[list_position(p, list_max(p))] AS predicted_fault, 1 - p[{CLASSES.index(NORMAL) + 1}] AS score
  FROM probable)"""
_FAULTY = "predicted_fault <> 'normal' AND score >= {0}"


@query("p28_verdicts", with_sql(JUDGED, f"SELECT {ROW}, predicted_fault, {r6('confidence')}, {r6('score')} FROM judged"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = verdict(_probable(spark, sf_dir), CLASSES)
    return rounded(judged, "confidence", "score").select(SCENARIO, "zone_id", SEQ, "predicted_fault", "confidence", "score")


_CLASSIFIED = f"""
SELECT scenario_file, epoch_us(event_time) AS event_us, zone_id, predicted_fault AS violated_policy,
  CASE WHEN confidence >= 0.8e0 THEN 'CRITICAL' WHEN confidence >= 0.5e0 THEN 'WARNING' ELSE 'INFO' END AS alert_level,
  round(score, 6) AS anomaly_index, 'fault_classifier' AS trigger_signal, 'classifier' AS detector_source, fault_type AS ground_truth,
  predicted_fault, round(confidence, 6) AS confidence FROM judged"""


@query("d7_classifier_hits", with_sql(JUDGED, f"{_CLASSIFIED} WHERE {_FAULTY.format('0.5')}"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = fault_hits(verdict(_probable(spark, sf_dir), CLASSES))
    return shown(hits, "predicted_fault", "confidence").withColumn("confidence", F.round("confidence", 6))


class _Given(Backend):
    """The derived probabilities in place of a model's."""

    kind = "given"

    def __init__(self) -> None:
        super().__init__()
        self.classes = CLASSES

    def fit(self, rows: DataFrame, classes: list[str]) -> None:
        """Nothing to learn."""

    def probabilities(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("probability", _derived())

    def models(self) -> dict:
        return {}

    def take(self, models: dict) -> None:
        """Nothing to take."""


@query("d8_calibrated_classifier", with_sql(FEATURE_ROWS + JUDGED.removeprefix(LONG).replace("FROM long", f"FROM features WHERE {_WHOLE}"), f"""
SELECT scenario_file, predicted_fault, count(*) AS n FROM judged
WHERE {_FAULTY.format("(SELECT quantile_cont(score, 0.95) FROM judged WHERE fault_type = 'normal')")} GROUP BY ALL"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = complete_rows(features(spark, sf_dir), ["fault_type"])
    classifier = FaultClassifier()
    classifier.backend, classifier.fitted = _Given(), True
    hits = classifier.calibrate(rows, 0.05).predict(rows)
    return hits.groupBy(SCENARIO, "predicted_fault").agg(F.count("*").alias("n"))


def _u(a: int, b: int) -> Column:
    return (F.col(SEQ) * a + b) % 32 / F.lit(32.0)


def _u_sql(a: int, b: int) -> str:
    return f"(((row_seq * {a} + {b}) % 32) / 32e0)"


_PARTS = f"""
parts AS (
  SELECT *, {_u_sql(3, 1)} AS pf, {_u_sql(5, 2)} AS f1, {_u_sql(7, 3)} AS f2, {_u_sql(11, 4)} AS f3, {_u_sql(13, 5)} AS po, {_u_sql(17, 6)} AS pd FROM long),
raw AS (SELECT *, pf * f1 * (1 - po) AS coi_bias, pf * f3 AS coi_leakage, pf * f2 * (1 - pd) AS coi_stuck,
  pf * f2 * pd AS damper_stuck, 1 - pf AS normal, pf * f1 * po AS oa_bias FROM parts),
summed AS (SELECT *, coi_bias + coi_leakage + coi_stuck + damper_stuck + normal + oa_bias AS total FROM raw)"""


@query("d9_cascade_algebra", with_sql(f"{LONG},{_PARTS}", f"""
SELECT {ROW}, {', '.join(r6(f'{c} / CASE WHEN total = 0 THEN 1 ELSE total END', c) for c in CLASSES)} FROM summed"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = F.array(_u(5, 2), _u(7, 3), _u(11, 4))
    p = cascade_probabilities(_u(3, 1), family, _u(13, 5), _u(17, 6), CLASSES)
    rows = long(spark, sf_dir).withColumn("p", p)
    return rounded(rows.select(SCENARIO, "zone_id", SEQ, *[F.col("p")[i].alias(c) for i, c in enumerate(CLASSES)]), *CLASSES)


# --- a Gaussian with a closed form --------------------------------------------------

_RIDGED = "(1e0 + 1e-3)"
_NLL = (f"0.5e0 * (({' + '.join(f'pow(({c} - m_{c}) / s_{c}, 2)' for c in FEATURES)}) / {_RIDGED} "
        f"+ {len(FEATURES)} * ln(2 * pi() * {_RIDGED}))")


def _gaussian(train: str) -> str:
    """Scores of all complete rows, and thresholds from rows matching ``train``."""
    return f""",
moments AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in FEATURES)}
  FROM features WHERE {_WHOLE} AND fault_type = 'normal' AND {train}),
scored AS (SELECT *, {_NLL} AS score FROM features, moments WHERE {_WHOLE}),
thresholds AS (SELECT quantile_cont(score, 0.9) AS warning, quantile_cont(score, 0.99) AS critical FROM scored WHERE fault_type = 'normal' AND {train})"""


GAUSSIAN = HITS + _gaussian("true") + """,
gaussian_hits AS (
  SELECT scenario_file, event_time, zone_id, 'ANOMALY_SCORE' AS violated_policy,
    CASE WHEN score >= critical THEN 'CRITICAL' WHEN score >= warning THEN 'WARNING' ELSE 'INFO' END AS alert_level, score AS anomaly_index,
    'gmm_nll_score' AS trigger_signal, 'gmm_detector' AS detector_source, fault_type AS ground_truth
  FROM scored, thresholds WHERE score >= warning)"""
_HIT4 = HIT_SQL.replace("round(anomaly_index, 6)", "round(anomaly_index + 1.2345e-7, 4)")


def _shown4(hits: DataFrame, *extra: str) -> DataFrame:
    """A score sums over 31 features, so fewer digits are sure."""
    return shown(hits.withColumn("anomaly_index", F.round(F.col("anomaly_index") + 1.2345e-7, 4)), *extra)


def _closed_form(rows: DataFrame) -> MixtureDetector:
    return MixtureDetector(components=1, covariance="diag").fit(rows)


@query("d1_gaussian_hits", with_sql(GAUSSIAN, f"SELECT {_HIT4} FROM gaussian_hits"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_features(spark, sf_dir)
    return _shown4(_closed_form(rows).predict(rows))


@query("d2_calibrated_gaussian", with_sql(LONG + ", " + ANNUAL + FEATURE_ROWS.removeprefix(LONG) + """,
timed AS (SELECT f.*, s.split FROM features f JOIN split_rows s USING (scenario_file, zone_id, row_seq))""" + _gaussian("split = 'train'").replace("FROM features", "FROM timed"), """
SELECT round(quantile_cont(score, 0.9), 4) AS warning, round(greatest((SELECT critical FROM thresholds), quantile_cont(score, 0.9)), 4) AS critical
FROM scored WHERE fault_type = 'normal' AND split = 'validation'"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = split_rows(run_features(spark, sf_dir))
    detector = train_unsupervised(split, MixtureDetector(components=1, covariance="diag"), target_fpr=0.1)
    return spark.range(1).select(F.round(F.lit(detector.warning), 4).alias("warning"), F.round(F.lit(detector.critical), 4).alias("critical"))


ENSEMBLE = GAUSSIAN + """,
either AS (
  SELECT scenario_file, event_time, zone_id, violated_policy, alert_level, anomaly_index, trigger_signal, detector_source FROM rule_events
  UNION ALL SELECT * EXCLUDE (ground_truth) FROM gaussian_hits),
winners AS (SELECT * FROM either QUALIFY row_number() OVER (PARTITION BY scenario_file, event_time, zone_id
  ORDER BY anomaly_index DESC, detector_source = 'rules' DESC, detector_source, violated_policy, trigger_signal) = 1),
sources AS (SELECT scenario_file, event_time, zone_id, string_agg(DISTINCT detector_source, '|' ORDER BY detector_source) AS all_sources FROM either GROUP BY ALL),
ensemble AS (SELECT w.*, s.all_sources, l.fault_type AS ground_truth FROM winners w JOIN sources s USING (scenario_file, event_time, zone_id)
  LEFT JOIN long l USING (scenario_file, event_time, zone_id))"""


@query("d12_ensemble", with_sql(ENSEMBLE, f"SELECT {_HIT4}, all_sources FROM ensemble"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_features(spark, sf_dir)
    return _shown4(detect(rows, [RuleDetector(), _closed_form(rows)]), "all_sources")


@query("d12_ensemble_report", with_sql(ENSEMBLE, """
SELECT l.scenario_file, count(*) AS n, count(e.zone_id) AS detected_rows FROM long l LEFT JOIN ensemble e USING (scenario_file, event_time, zone_id) GROUP BY ALL"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_features(spark, sf_dir)
    events = detect(rows, [RuleDetector(), _closed_form(rows)])
    return scenario_report(label_detections(rows, events)).select(SCENARIO, "n", "detected_rows")


# --- models of MLlib ----------------------------------------------------------------


def _run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Split]:
    rows = run_features(spark, sf_dir)
    return rows, split_rows(rows)


@query("d1_mixture")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, split = _run(spark, sf_dir)
    return shown(train_unsupervised(split, MixtureDetector()).predict(split.evaluation))


@query("d3_isolation_forest")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, split = _run(spark, sf_dir)
    return shown(train_unsupervised(split, IsolationForestDetector()).predict(split.evaluation))


@query("d4_reconstruction_error")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, split = _run(spark, sf_dir)
    return shown(train_unsupervised(split, ReconstructionDetector()).predict(split.evaluation))


def _register_classifier(name: str, backend: str) -> None:
    @query(name)
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        _, split = _run(spark, sf_dir)
        classifier = train_classifier(split, FaultClassifier(backend))
        return shown(classifier.predict(split.evaluation), "predicted_fault", "confidence")


_register_classifier("d5_random_forest", "random_forest")
_register_classifier("d6_boosted_trees", "boosted")
_register_classifier("d9_cascade", "cascade")
_register_classifier("d10_sequence", "sequence")
_register_classifier("d11_neural", "neural")
_register_classifier("d11_graph", "graph")


@query("d13_fused_run")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and mixture fused, annotated by a classifier."""
    _, split = _run(spark, sf_dir)
    mixture = train_unsupervised(split, MixtureDetector(), target_fpr=0.1)
    classifier = train_classifier(split, FaultClassifier("random_forest"))
    return shown(detect(split.evaluation, [RuleDetector(), mixture], classifier), "all_sources", "predicted_fault", "confidence")


@query("d14_classifier_only")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, split = _run(spark, sf_dir)
    classifier = train_classifier(split, FaultClassifier("random_forest"))
    return shown(detect(split.evaluation, [], classifier), "predicted_fault", "confidence")


_HELD_OUT = with_sql(LONG + ", " + COMMON + HITS.removeprefix(LONG) + """,
timed AS (SELECT f.*, s.split FROM features f JOIN split_rows s USING (scenario_file, zone_id, row_seq))"""
    + _gaussian("split = 'train'").replace("FROM features", "FROM timed") + """,
flags AS (
  SELECT t.scenario_file, t.fault_type, coalesce(s.score >= (SELECT warning FROM thresholds), false) OR r.rule_no IS NOT NULL AS detected
  FROM timed t LEFT JOIN scored s USING (scenario_file, zone_id, row_seq)
  LEFT JOIN rule_events r ON r.scenario_file = t.scenario_file AND r.zone_id = t.zone_id AND r.event_time = t.event_time
  WHERE t.split = 'final'),
counts AS (SELECT scenario_file, fault_type, count(*) AS n, count(*) FILTER (detected) AS hits FROM flags GROUP BY ALL),
reference AS (SELECT n AS normal_n, hits AS fp FROM counts WHERE fault_type = 'normal')""", """
SELECT scenario_file AS scenario, 'rules_gmm' AS model, n + normal_n AS n_evaluated,
  round(CASE WHEN hits + fp > 0 THEN hits / (hits + fp) ELSE 0 END, 4) AS detection_precision, round(hits / n, 4) AS detection_recall,
  round(CASE WHEN n + hits + fp > 0 THEN 2 * hits / (n + hits + fp) ELSE 0 END, 4) AS detection_f1, round(fp / normal_n, 4) AS normal_reference_fpr,
  NULL::DOUBLE AS classification_accuracy, NULL::DOUBLE AS classification_macro_f1
FROM counts, reference WHERE fault_type <> 'normal'""")


@query("a16_hold_out_summary", _HELD_OUT)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detectors learn from normal rows only, so in SQL the runs differ by their evaluation rows alone."""
    rows = run_features(spark, sf_dir)
    return hold_out_gaussian_summary(rows, fault_scenarios(rows))


_HELD_OUT_CLASSES = with_sql(
    LONG + ", " + COMMON + FEATURE_ROWS.removeprefix(LONG) + JUDGED.removeprefix(LONG).replace("FROM long", f"FROM features WHERE {_WHOLE}") + f""",
timed AS (SELECT f.*, s.split FROM features f JOIN split_rows s USING (scenario_file, zone_id, row_seq) WHERE s.split = 'final'),
hits AS (SELECT scenario_file, event_time, zone_id, min(predicted_fault) AS predicted FROM judged WHERE {_FAULTY.format('0.5')} GROUP BY ALL),
flags AS (
  SELECT t.scenario_file, t.fault_type, h.predicted IS NOT NULL AS detected, coalesce(h.predicted, 'normal') AS predicted
  FROM timed t LEFT JOIN hits h USING (scenario_file, event_time, zone_id)),
held AS (SELECT DISTINCT scenario_file AS scenario FROM flags WHERE fault_type <> 'normal'),
judgements AS (SELECT h.scenario, f.* FROM held h JOIN flags f ON f.scenario_file = h.scenario OR f.fault_type = 'normal'),
named AS (SELECT scenario, fault_type AS label FROM judgements UNION SELECT scenario, predicted FROM judgements),
f1s AS (
  SELECT scenario, label, 2 * count(*) FILTER (fault_type = label AND predicted = label)
    / (count(*) FILTER (fault_type = label) + count(*) FILTER (predicted = label)) AS f1
  FROM named JOIN judgements USING (scenario) GROUP BY ALL),
macro AS (SELECT scenario, round(avg(f1), 4) AS classification_macro_f1 FROM f1s GROUP BY ALL),
sums AS (
  SELECT scenario, count(*) AS n, count(*) FILTER (fault_type <> 'normal' AND detected) AS tp, count(*) FILTER (fault_type = 'normal' AND detected) AS fp,
    count(*) FILTER (fault_type <> 'normal' AND NOT detected) AS fn, count(*) FILTER (fault_type = 'normal') AS normal_n,
    count(*) FILTER (fault_type = predicted) AS correct
  FROM judgements GROUP BY ALL)""", """
SELECT scenario, 'given' AS model, n AS n_evaluated, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 4) AS detection_precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 4) AS detection_recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 4) AS detection_f1,
  round(fp / normal_n, 4) AS normal_reference_fpr, round(correct / n, 4) AS classification_accuracy, classification_macro_f1
FROM sums JOIN macro USING (scenario)""")


@query("a16_hold_out_classified", _HELD_OUT_CLASSES)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A classifier alone: every scenario is held out, judged and counted with the normal reference."""
    rows = run_features(spark, sf_dir)

    def train_and_detect(split: Split) -> DataFrame:
        classifier = FaultClassifier()
        classifier.backend, classifier.fitted = _Given(), True
        return detect(split.evaluation, [], classifier)

    return hold_out_summary(rows, fault_scenarios(rows), train_and_detect, "given", used_classifier=True)


def every_kind() -> list[Detector]:
    """One detector of each kind that learns, as its defaults have it."""
    return [MixtureDetector(), IsolationForestDetector(), ReconstructionDetector(), *map(FaultClassifier, BACKENDS)]


@query("s17_saved_models")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of detectors that were saved and loaded again."""
    _, split = _run(spark, sf_dir)
    found = []
    for detector in every_kind():
        path = scratch_path(spark, "model")
        train = train_classifier if isinstance(detector, FaultClassifier) else train_unsupervised
        train(split, detector).save(spark, path)
        found.append(shown(type(detector).load(spark, path).predict(split.evaluation)))
    return stack(found).groupBy("detector_source", "alert_level").agg(F.count("*").alias("n"))
