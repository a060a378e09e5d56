"""What trained detectors keep to, counted by scenario, whatever they have learned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airsleuth.detectors.base import ScoreDetector
from airsleuth.detectors.classifier import SOURCE, FaultClassifier, columns_read
from airsleuth.operators.rules import rule_events
from airsleuth.operators.splits import normal_rows
from airsleuth.schema import NORMAL, ROW_KEYS, SCENARIO

#: A loaded model's score may differ from the saved one's by so much.
SAME = 1e-9


def share_kept(scores: DataFrame, threshold: float, share: float) -> bool:
    """Whether a threshold leaves ``share`` of the scores above it, ties with the threshold aside.

    With ``n`` scores at most ``share`` * (n - 1) + 1 are above the interpolated quantile, and at least
    ``share`` * (n - 1) are not below it.
    """
    score = F.col("score")
    n, above, reached = scores.agg(F.count("score"), F.count_if(score > threshold), F.count_if(score >= threshold)).first()
    # The product of a share and a count is not exact.
    return n > 0 and above <= share * (n - 1) + 1 + 1e-6 and reached >= share * (n - 1) - 1e-6


def _counted(rows: DataFrame, valid: Column, changed: Column, kept: bool) -> DataFrame:
    return rows.groupBy(SCENARIO).agg(
        F.count("*").alias("n"), F.count_if(valid).alias("n_valid"),
        F.count_if(F.coalesce(changed, F.lit(True))).alias("n_changed"), F.lit(kept).alias("share_kept"))


def score_contract(spark: SparkSession, detector: ScoreDetector, train: DataFrame, rows: DataFrame, path: str) -> DataFrame:
    """Complete rows, those with a finite score, and those that the detector scores anew after it was saved to
    ``path`` and loaded; whether its warning threshold leaves the share of normal training rows above it that it promises."""
    detector.save(spark, path)
    again = type(detector).load(spark, path)
    both = again.score(detector.score(rows).withColumnRenamed("score", "_first"))
    first = F.col("_first")
    same_thresholds = (again.warning, again.critical) == (detector.warning, detector.critical)
    kept = share_kept(detector.score(normal_rows(train)).select("score"), detector.warning, 1 - detector.percentiles[0])
    return _counted(both, first.isNotNull() & ~F.isnan(first) & (F.abs(first) < float("inf")),
                    (F.abs(F.col("score") - first) > SAME) | F.lit(not same_thresholds), kept)


def classifier_contract(spark: SparkSession, classifier: FaultClassifier, validation: DataFrame, rows: DataFrame, path: str,
                        target_fpr: float) -> DataFrame:
    """Complete rows, those whose probabilities are a distribution with the verdict at its top, and those judged
    anew after saving and loading; whether calibration leaves ``target_fpr`` of the normal validation rows above."""
    classifier.calibrate(validation, target_fpr).save(spark, path)
    again = FaultClassifier.load(spark, path)
    judged = {"probability": "_vector", "predicted_fault": "_fault", "confidence": "_confidence", "score": "_score"}
    both = again.judge(classifier.judge(columns_read(rows)).withColumnsRenamed(judged))
    classes, p = classifier.backend.classes, F.col("_vector")
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    valid = (
        (F.size(p) == len(classes)) & (F.abs(total - 1) < 1e-6) & ~F.exists(p, lambda x: (x < 0) | F.isnan(x))
        & (F.col("_confidence") == F.array_max(p)) & (F.get(p, F.array_position(F.lit(classes), F.col("_fault")).cast("int") - 1) == F.col("_confidence"))
        & (F.abs(1 - F.get(p, F.lit(classes.index(NORMAL))) - F.col("_score")) < SAME)
    )
    changed = (F.col("predicted_fault") != F.col("_fault")) | (F.abs(F.col("score") - F.col("_score")) > SAME)
    normals = classifier.judge(columns_read(normal_rows(validation))).select("score")
    same_threshold = again.threshold == classifier.threshold
    return _counted(both, F.coalesce(valid, F.lit(False)), changed | F.lit(not same_threshold),
                    share_kept(normals, classifier.threshold, target_fpr))


def fused_contract(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Keys with a rule event, how many of them have an event that names the rules, and events that repeat a key or have no label."""
    keys = rule_events(rows).select(*ROW_KEYS).distinct().withColumn("_rule", F.lit(1))
    per_key = events.groupBy(*ROW_KEYS).agg(
        F.count("*").alias("_n"), F.bool_or(F.array_contains(F.split("all_sources", r"\|"), "rules")).alias("_named"),
        F.count_if(F.col("ground_truth").isNull()).alias("_unlabelled"))
    return keys.join(per_key, ROW_KEYS, "full_outer").groupBy(SCENARIO).agg(
        F.count("_rule").alias("n_rules"), F.count_if(F.col("_rule").isNotNull() & F.col("_named")).alias("n_named"),
        F.count_if(F.col("_rule").isNull() & F.col("_named")).alias("n_unfounded"),
        F.count_if(F.col("_n") > 1).alias("n_repeated"), F.coalesce(F.sum("_unlabelled"), F.lit(0)).alias("n_unlabelled"),
    ).filter("n_rules > 0 or n_unfounded > 0 or n_repeated > 0 or n_unlabelled > 0")


def classified_contract(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Row keys, and events of the classifier alone that repeat a key, lie outside the rows, or do not say what it judged."""
    per_key = events.groupBy(*ROW_KEYS).agg(
        F.count("*").alias("_n"),
        F.count_if(~F.coalesce((F.col("detector_source") == SOURCE) & (F.col("violated_policy") == F.col("predicted_fault"))
                               & (F.col("predicted_fault") != NORMAL) & F.col("ground_truth").isNotNull(), F.lit(False))).alias("_odd"))
    keys = rows.groupBy(*ROW_KEYS).agg(F.count("*").alias("_rows"))
    return keys.join(per_key, ROW_KEYS, "full_outer").groupBy(SCENARIO).agg(
        F.count("_rows").alias("n_keys"), F.count_if(F.col("_n") > F.coalesce("_rows", F.lit(0))).alias("n_repeated"),
        F.coalesce(F.sum("_odd"), F.lit(0)).alias("n_odd"))
