"""Contracts of trained detectors beside SQL: what holds whatever was learned, counted over the rows of the final window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from airsleuth.catalog.base import FEATURE_ROWS, HITS, LONG, query, with_sql
from airsleuth.catalog.ingest import ANNUAL
from airsleuth.catalog.learned import _WHOLE, run_features
from airsleuth.detectors.base import RuleDetector, ScoreDetector
from airsleuth.detectors.classifier import FaultClassifier
from airsleuth.detectors.contract import classified_contract, classifier_contract, fused_contract, score_contract
from airsleuth.detectors.scores import IsolationForestDetector, MixtureDetector, ReconstructionDetector
from airsleuth.plans.detection import detect, split_rows, train_classifier, train_unsupervised
from airsleuth.session import scratch_path

_FINAL = """,
final AS (SELECT f.* FROM features f JOIN split_rows s USING (scenario_file, zone_id, row_seq) WHERE s.split = 'final')"""
_TIMED = LONG + ", " + ANNUAL + FEATURE_ROWS.removeprefix(LONG) + _FINAL
_KEPT = with_sql(_TIMED, f"""
SELECT scenario_file, count(*) AS n, count(*) AS n_valid, 0 AS n_changed, true AS share_kept FROM final WHERE {_WHOLE} GROUP BY ALL""")


def _register_scores(name: str, make: Callable[[], ScoreDetector]) -> None:
    @query(name, _KEPT)
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        split = split_rows(run_features(spark, sf_dir))
        return score_contract(spark, train_unsupervised(split, make()), split.train, split.evaluation, scratch_path(spark, "model"))


def _register_classifier(name: str, backend: str) -> None:
    @query(name, _KEPT)
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        split = split_rows(run_features(spark, sf_dir))
        classifier = train_classifier(split, FaultClassifier(backend))
        return classifier_contract(spark, classifier, split.validation, split.evaluation, scratch_path(spark, "model"), 0.1)


_register_scores("d1_mixture_contract", MixtureDetector)
_register_scores("d3_isolation_forest_contract", IsolationForestDetector)
_register_scores("d4_reconstruction_contract", ReconstructionDetector)
_register_classifier("d5_random_forest_contract", "random_forest")
_register_classifier("d6_boosted_trees_contract", "boosted")
_register_classifier("d9_cascade_contract", "cascade")
_register_classifier("d10_sequence_contract", "sequence")
_register_classifier("d11_neural_contract", "neural")
_register_classifier("d11_graph_contract", "graph")


@query("d13_fused_contract", with_sql(LONG + ", " + ANNUAL + HITS.removeprefix(LONG) + _FINAL, """
SELECT scenario_file, count(*) AS n_rules, count(*) AS n_named, 0 AS n_unfounded, 0 AS n_repeated, 0 AS n_unlabelled
FROM (SELECT DISTINCT r.scenario_file, r.event_time, r.zone_id FROM rule_events r JOIN final f USING (scenario_file, zone_id, row_seq)) GROUP BY ALL"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = split_rows(run_features(spark, sf_dir))
    mixture = train_unsupervised(split, MixtureDetector(), target_fpr=0.1)
    classifier = train_classifier(split, FaultClassifier("random_forest"))
    return fused_contract(split.evaluation, detect(split.evaluation, [RuleDetector(), mixture], classifier))


@query("d14_classifier_only_contract", with_sql(_TIMED, """
SELECT scenario_file, count(*) AS n_keys, 0 AS n_repeated, 0 AS n_odd FROM (SELECT DISTINCT scenario_file, event_time, zone_id FROM final) GROUP BY ALL"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = split_rows(run_features(spark, sf_dir))
    classifier = train_classifier(split, FaultClassifier("random_forest"))
    return classified_contract(split.evaluation, detect(split.evaluation, [], classifier))
