"""Hold-outs: each scenario is judged by what was learned without it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airsleuth.detectors.base import Detector, RuleDetector
from airsleuth.detectors.scores import MixtureDetector, Scaler
from airsleuth.errors import FeatureEngineeringError
from airsleuth.functions.columns import is_fault, ratio
from airsleuth.operators.evaluation import class_summary, label_detections, round4
from airsleuth.operators.fusion import stack
from airsleuth.operators.splits import complete_rows, is_normal_reference, normal_rows, only_scenario, temporal_split
from airsleuth.plans.detection import Split, detect, split_rows
from airsleuth.schema import FEATURES, SCENARIO
from airsleuth.session import cut_lineage

#: A variance this small beside the whole's is what rounding leaves of none.
ROUNDING = 1e-12


class Moments(NamedTuple):
    """Rows, means and population variances of the features; they can be taken away from those of a bigger set."""

    rows: int
    means: np.ndarray
    variances: np.ndarray

    def without(self, part: Moments) -> Moments:
        """Moments of the rows that are not in ``part``."""
        rest = self.rows - part.rows
        if rest <= 0:
            raise FeatureEngineeringError("no complete normal rows to train on")
        means = (self.rows * self.means - part.rows * part.means) / rest
        apart = part.rows * rest / self.rows * (part.means - means) ** 2
        variances = (self.rows * self.variances - part.rows * part.variances - apart) / rest
        scale = self.variances + self.means ** 2 * ROUNDING
        return Moments(rest, means, np.where(variances <= scale * ROUNDING, 0.0, variances))

    def scaler(self) -> Scaler:
        stds = np.sqrt(self.variances)
        return Scaler(self.means.tolist(), np.where(stds == 0, 1.0, stds).tolist())


def moments_by_scenario(normals: DataFrame, scenarios: Sequence[str]) -> tuple[Moments, dict[str, Moments]]:
    """Moments of all rows and of those scenarios that have any, in one pass; only these reach the driver."""
    found = (
        normals.rollup(SCENARIO)
        .agg(F.grouping(SCENARIO).alias("_all"), F.count("*").alias("_n"), F.array(*[F.avg(c) for c in FEATURES]).alias("_m"),
             F.array(*[F.var_pop(c) for c in FEATURES]).alias("_v"))
        .filter((F.col("_all") == 1) | F.col(SCENARIO).isin(list(scenarios))).collect()
    )
    each = {None if r["_all"] else r[SCENARIO]: Moments(r["_n"], np.array(r["_m"], dtype=float), np.array(r["_v"], dtype=float))
            for r in found}
    whole = each.pop(None, None)
    if whole is None or whole.rows == 0:
        raise FeatureEngineeringError("no complete normal rows to train on")
    return whole, each


def held_out_gaussians(train: DataFrame, scenarios: Sequence[str]) -> dict[str, MixtureDetector]:
    """For each scenario the Gaussian with a closed form that learned from all normal rows but its own.

    No model is fitted anew: a scenario's moments are taken away from the whole's. Scenarios without
    normal rows, which all faults are, share one detector, so there are as many passes for
    thresholds as held-out scenarios with normal rows, and one.
    """
    normals = cut_lineage(complete_rows(normal_rows(train)).select(SCENARIO, *FEATURES))
    whole, each = moments_by_scenario(normals, scenarios)

    def gaussian(moments: Moments, rows: DataFrame) -> MixtureDetector:
        detector = MixtureDetector(components=1, covariance="diag")
        detector.scaler = moments.scaler()
        detector.set_thresholds(rows)
        return detector

    shared = gaussian(whole, normals) if set(scenarios) - set(each) else None
    return {s: gaussian(whole.without(each[s]), normals.filter(~F.col(SCENARIO).eqNullSafe(s))) if s in each else shared
            for s in scenarios}


def hold_out_report(labelled: DataFrame, scenarios: Sequence[str], model: str, used_classifier: bool = False) -> DataFrame:
    """One row per held-out scenario from labelled rows of all of them and of the normal reference.

    Rows are counted by label, prediction and flag first; only the reference's counts are
    copied to every scenario. Without a classifier the classification columns are null. A scenario
    without rows has no row.
    """
    counts = labelled.groupBy(SCENARIO, "fault_type", "predicted_fault", "detected").agg(F.count("*").alias("n"))
    wanted = F.when(is_normal_reference(), F.lit(list(scenarios))).when(
        F.col(SCENARIO).isin(list(scenarios)), F.array(SCENARIO))
    counts = counts.withColumns({"_reference": is_normal_reference(), "scenario": F.explode(wanted)})
    truth, hit = is_fault(F.col("fault_type")), F.col("detected")
    # A scenario is judged by rows of its own, not by the reference alone.
    own = ~F.col("_reference") | (F.col(SCENARIO) == F.col("scenario"))

    def total(where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, F.col("n"))), F.lit(0))

    sums = counts.groupBy("scenario").agg(
        total(F.col("fault_type").isNotNull()).alias("n_evaluated"), total(truth & hit).alias("_tp"), total(~truth & hit).alias("_fp"),
        total(truth & ~hit).alias("_fn"), total(F.col("_reference")).alias("_normal"), total(F.col("_reference") & hit).alias("_false"),
        F.bool_or(F.col("_reference") & truth).alias("_mixed"), F.bool_or(own).alias("_own"),
    ).filter("_own")
    tp, fp, fn = F.col("_tp"), F.col("_fp"), F.col("_fn")
    detection = sums.select(
        "scenario", F.lit(model).alias("model"), "n_evaluated",
        round4(ratio(tp, tp + fp)).alias("detection_precision"), round4(ratio(tp, tp + fn)).alias("detection_recall"),
        round4(ratio(2 * tp, 2 * tp + fp + fn)).alias("detection_f1"),
        F.when((F.col("_normal") > 0) & ~F.coalesce("_mixed", F.lit(False)), round4(ratio(F.col("_false"), F.col("_normal"))))
        .alias("normal_reference_fpr"),
    )
    if not used_classifier:
        none = F.lit(None).cast("double")
        return detection.withColumns({"classification_accuracy": none, "classification_macro_f1": none})
    confusion = counts.groupBy("scenario", F.col("fault_type").alias("truth"), F.col("predicted_fault").alias("prediction")).agg(
        F.sum("n").alias("n"))
    classes = class_summary(confusion, by=("scenario",)).select(
        "scenario", F.col("accuracy").alias("classification_accuracy"), F.col("macro_f1").alias("classification_macro_f1"))
    return detection.join(classes, "scenario")


def hold_out_summary(features: DataFrame, scenarios: Sequence[str], train_and_detect: Callable[[Split], DataFrame],
                     model: str, protocol: str = "common", used_classifier: bool = False) -> DataFrame:
    """One row per held-out scenario, each trained and detected anew, one after the other.

    ``train_and_detect(split)`` trains on the split and returns the events of its evaluation rows. ``features`` is
    read several times, so it should be a written table; only the final window's rows are written anew.
    """
    parts, parted = [], temporal_split(features, protocol)
    final = cut_lineage(split_rows(parted, protocol).evaluation)
    for scenario in scenarios:
        split = replace(split_rows(parted, protocol, held_out=scenario), evaluation=only_scenario(final, scenario, True))
        labelled = label_detections(split.evaluation, train_and_detect(split))
        parts.append(cut_lineage(hold_out_report(labelled, [scenario], model, used_classifier)))
    return stack(parts)


def hold_out_gaussian_summary(features: DataFrame, scenarios: Sequence[str], model: str = "rules_gmm", protocol: str = "common",
                              others: Sequence[Detector] = (RuleDetector(),)) -> DataFrame:
    """The summary of ``others``, which learn nothing, beside the closed-form Gaussian, without fitting anew.

    Scenarios that share a detector are detected and counted together, in one plan. ``features`` is read several
    times, so it should be a written table; only the final window's rows are written anew.
    """
    parted = temporal_split(features, protocol)
    detectors = held_out_gaussians(parted.filter(F.col("split") == "train"), scenarios)
    final = cut_lineage(split_rows(parted, protocol).evaluation)
    parts = []
    for detector in dict.fromkeys(detectors.values()):
        members = [s for s in scenarios if detectors[s] is detector]
        rows = final.filter(F.col(SCENARIO).isin(members) | is_normal_reference())
        labelled = label_detections(rows, detect(rows, [*others, detector]))
        parts.append(hold_out_report(labelled, members, model))
    return stack(parts)
