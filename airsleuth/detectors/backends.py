"""Class probabilities from MLlib models, boosted trees and sequence and graph models.

A backend is fitted on rows with FEATURES and ``fault_type`` and adds
``probability``, an array in the order of its sorted ``classes``.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.classification import (
    LogisticRegression, LogisticRegressionModel, MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airsleuth.detectors.boosting import Boosted, fit_boosting
from airsleuth.detectors.convolution import Kernels, response_names, streamed
from airsleuth.detectors.forest import Forest, fit_forest
from airsleuth.detectors.graph import adjacency
from airsleuth.detectors.runs import COUNT, counted_runs, counted_series, fewest_copies
from airsleuth.detectors.scores import Scaler, covariance, once_per_row
from airsleuth.functions.columns import fault_family, is_fault
from airsleuth.functions.quantiles import moments
from airsleuth.operators.ordered import stream_series
from airsleuth.operators.sequence import SEQUENCE_ROWS, pad_head
from airsleuth.schema import FEATURES, NORMAL
from airsleuth.session import cut_lineage

LABEL, VECTOR, WEIGHT = "label", "features", "weight"


def label_index(label: Column, classes: list[str]) -> Column:
    """Place of a label among the alphabetically sorted classes, from 0."""
    return (F.array_position(F.lit(classes), label) - 1).cast("double")


def class_weights(df: DataFrame) -> dict[str, float]:
    """Balanced weight per class: rows / (classes * rows of the class). Rows of a counted table are as many as they stand for."""
    rows = F.sum(COUNT) if COUNT in df.columns else F.count("*")
    counts = {r["fault_type"]: r["n"] for r in df.groupBy("fault_type").agg(rows.alias("n")).collect()}
    total = sum(counts.values())
    return {c: total / (len(counts) * n) for c, n in sorted(counts.items())}


def balanced(df: DataFrame, weights: dict[str, float], ids: list[str], seed: int = 42) -> DataFrame:
    """Rows repeated or thinned so that every class weighs the same on average."""
    weight = F.create_map(*[F.lit(v) for pair in weights.items() for v in pair])[F.col("fault_type")]
    uniform = F.pmod(F.xxhash64(F.lit(seed), *ids), F.lit(1 << 20)) / F.lit(float(1 << 20))
    copies = F.floor(weight + uniform).cast("int")
    return (
        df.withColumn("_copies", copies).filter(F.col("_copies") > 0)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copies", "_copy")
    )


def share_out(parts: list[Column]) -> Column:
    """Parts divided by their sum, as an array; zeros stay zeros."""
    total = sum(parts[1:], parts[0])
    return F.array(*[p / F.when(total == 0, F.lit(1.0)).otherwise(total) for p in parts])


def counted_rows(rows: DataFrame) -> DataFrame:
    """What backends learn from as a written table: equal rows that follow one another once, with their count."""
    return cut_lineage(counted_runs(rows, [*FEATURES, "fault_type"]))


def _vector(columns: list[Column]) -> Column:
    return array_to_vector(F.array(*columns))


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns as the output of a generator with one row.

    Spark replaces a column by its expression wherever it is used, in conditions
    too, and would run a model again for each use. It does not look through a
    generator.
    """
    own = [c for c in df.columns if c not in columns]
    values = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*own, F.inline(F.array(values)))


class Backend(ABC):
    """Fits, scores, saves and loads one kind of model."""

    kind = ""

    def __init__(self, seed: int = 42, **options: Any) -> None:
        self.seed, self.options = seed, options
        self.classes: list[str] = []

    def kept(self, rows: DataFrame) -> DataFrame:
        """Training rows as a written table, as ``fit`` reads them."""
        return cut_lineage(rows)

    @abstractmethod
    def fit(self, rows: DataFrame, classes: list[str]) -> None: ...

    @abstractmethod
    def probabilities(self, rows: DataFrame) -> DataFrame: ...

    @abstractmethod
    def models(self) -> dict[str, Model]:
        """MLlib models by name."""

    @abstractmethod
    def take(self, models: dict[str, Model]) -> None: ...

    def state(self) -> dict[str, Any]:
        return {"kind": self.kind, "classes": self.classes, "seed": self.seed, "options": self.options}

    def restore(self, state: dict[str, Any]) -> None:
        self.classes = state["classes"]


class ForestBackend(Backend):
    """Random forest."""

    kind = "random_forest"

    def fit(self, rows: DataFrame, classes: list[str]) -> None:
        self.classes = classes
        self.forest = fit_forest(rows, classes, self.seed, **self.options)

    def probabilities(self, rows: DataFrame) -> DataFrame:
        return computed_once(rows, {"probability": self.forest.column()})

    def models(self) -> dict[str, Model]:
        return {}

    def take(self, models: dict[str, Model]) -> None:
        """The trees are part of the state."""

    def state(self) -> dict[str, Any]:
        return {**super().state(), "forest": self.forest.state()}

    def restore(self, state: dict[str, Any]) -> None:
        super().restore(state)
        self.forest = Forest.of(state["forest"])


class TreesBackend(Backend):
    """What backends on boosted trees share: one set of trees for all their outputs."""

    @abstractmethod
    def targets(self) -> dict[str, Column]:
        """1, 0 or null of each row by output."""

    def kept(self, rows: DataFrame) -> DataFrame:
        return counted_rows(rows)

    def fit(self, rows: DataFrame, classes: list[str]) -> None:
        self.classes = classes
        self.trees = fit_boosting(rows, self.targets(), **self.options)

    def models(self) -> dict[str, Model]:
        return {}

    def take(self, models: dict[str, Model]) -> None:
        """The trees are part of the state."""

    def state(self) -> dict[str, Any]:
        return {**super().state(), "trees": self.trees.state()}

    def restore(self, state: dict[str, Any]) -> None:
        super().restore(state)
        self.trees = Boosted.of(state["trees"])


class BoostedBackend(TreesBackend):
    """Boosted trees, one output per class against the rest."""

    kind = "boosted"

    def targets(self) -> dict[str, Column]:
        return {c: F.col("fault_type") == c for c in self.classes}

    def probabilities(self, rows: DataFrame) -> DataFrame:
        scored = rows.withColumn("_p", self.trees.column())
        return computed_once(scored, {"probability": share_out([F.col("_p")[i] for i in range(len(self.classes))])}).drop("_p")


def cascade_probabilities(p_fault: Column, family: Column, p_oa: Column, p_damper: Column,
                          classes: list[str]) -> Column:
    """Class probabilities of the cascade: products along the tree, then divided by their sum.

    ``family`` holds the probabilities of sensor_bias, actuator_stuck and
    actuator_leakage given a fault; ``p_oa`` that a bias is outside-air bias,
    ``p_damper`` that a stuck actuator is the damper. A null stage counts as 0.
    """
    parts = {
        "normal": 1 - p_fault,
        "coi_leakage": p_fault * family[2],
        "coi_bias": p_fault * family[0] * (1 - p_oa), "oa_bias": p_fault * family[0] * p_oa,
        "coi_stuck": p_fault * family[1] * (1 - p_damper), "damper_stuck": p_fault * family[1] * p_damper,
    }
    return share_out([F.coalesce(parts[c], F.lit(0.0)) if c in parts else F.lit(0.0) for c in classes])


class CascadeBackend(TreesBackend):
    """Normal or fault, then the fault's family, then the fault within the family; all stages are fitted at once."""

    kind = "cascade"
    FAMILIES = ["sensor_bias", "actuator_stuck", "actuator_leakage"]

    def targets(self) -> dict[str, Column]:
        label, faults = F.col("fault_type"), {c for c in self.classes if c != NORMAL}
        found = {"fault": is_fault(label)}
        if not faults:
            return found
        family = F.when(is_fault(label), fault_family(label))
        found |= {name: family == name for name in self.FAMILIES}
        if {"coi_bias", "oa_bias"} & faults:
            found["bias"] = F.when(family == "sensor_bias", label != "coi_bias")
        if {"coi_stuck", "damper_stuck"} & faults:
            found["stuck"] = F.when(family == "actuator_stuck", label != "coi_stuck")
        return found

    def probabilities(self, rows: DataFrame) -> DataFrame:
        p = {name: F.col("_p")[i] for i, name in enumerate(self.trees.names)}
        nothing = F.lit(None).cast("double")
        family = share_out([p[f] for f in self.FAMILIES]) if self.FAMILIES[0] in p else F.lit(None).cast("array<double>")
        # Families are a step of their own: written out wherever a class needs them, the code would not compile.
        scored = computed_once(rows.withColumn("_p", self.trees.column()), {"_family": family})
        return computed_once(scored, {"probability": cascade_probabilities(
            p["fault"], F.col("_family"), p.get("bias", nothing), p.get("stuck", nothing), self.classes)}).drop("_p", "_family")


class NeuralBackend(Backend):
    """Dense network on standardized features."""

    kind = "neural"

    def _scaled(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(VECTOR, _vector(Scaler(self.means, self.stds).columns()))

    def kept(self, rows: DataFrame) -> DataFrame:
        return counted_rows(rows)

    def _fit_network(self, counted: DataFrame) -> None:
        rows = fewest_copies(counted)
        self.means, self.stds = moments(rows, FEATURES)
        self._fit_head(rows, len(FEATURES))

    def _fit_head(self, rows: DataFrame, inputs: int) -> None:
        data = self._scaled(rows).select(VECTOR, label_index(F.col("fault_type"), self.classes).alias(LABEL))
        options = {"maxIter": 100, "hidden": 32, **self.options}
        layers = [inputs, options.pop("hidden"), len(self.classes)]
        self.model = MultilayerPerceptronClassifier(
            featuresCol=VECTOR, labelCol=LABEL, layers=layers, seed=self.seed, **options
        ).fit(data)

    def fit(self, rows: DataFrame, classes: list[str]) -> None:
        self.classes = classes
        self._fit_network(rows if COUNT in rows.columns else self.kept(rows))

    def _score(self, rows: DataFrame) -> DataFrame:
        scored = self.model.transform(self._scaled(rows))
        return computed_once(scored, {"probability": vector_to_array("probability")}).drop(VECTOR, "rawPrediction", "prediction")

    def probabilities(self, rows: DataFrame) -> DataFrame:
        return self._score(rows)

    def models(self) -> dict[str, Model]:
        return {"model": self.model}

    def take(self, models: dict[str, Model]) -> None:
        self.model = models["model"]

    def state(self) -> dict[str, Any]:
        return {**super().state(), "means": self.means, "stds": self.stds}

    def restore(self, state: dict[str, Any]) -> None:
        super().restore(state)
        self.means, self.stds = state["means"], state["stds"]


class GraphBackend(NeuralBackend):
    """Dense network on each signal and on two rounds of averages over its neighbours in a learned graph."""

    kind = "graph"

    def _scaled(self, rows: DataFrame) -> DataFrame:
        scaler, weights = Scaler(self.means, self.stds), np.array(self.adjacency)

        @F.pandas_udf("array<double>")
        def averaged(features: pd.DataFrame) -> pd.Series:
            own = scaler.batch(features)
            near = own @ weights.T
            return pd.Series(list(np.hstack([own, near, near @ weights.T])))

        return rows.withColumn(VECTOR, array_to_vector(once_per_row(averaged)))

    def _fit_network(self, counted: DataFrame) -> None:
        rows = fewest_copies(counted)
        self.means, self.stds = moments(rows, FEATURES)
        self.adjacency = adjacency(covariance(counted, Scaler(self.means, self.stds))).tolist()
        self._fit_head(rows, 3 * len(FEATURES))

    def state(self) -> dict[str, Any]:
        return {**super().state(), "adjacency": self.adjacency}

    def restore(self, state: dict[str, Any]) -> None:
        super().restore(state)
        self.adjacency = state["adjacency"]


class SequenceBackend(Backend):
    """Dilated convolutions over the last 30 rows of a series, and a multinomial head on them and the row itself.

    Responses are computed while rows stream by in series order, so windows are
    never laid out in memory. Training rows weigh by their class, and windows of equal series, as zones have, are
    computed once and counted.
    """

    kind = "sequence"

    def _windows(self, rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
        kernels = Kernels.drawn(len(FEATURES), self.seed)
        return stream_series(rows, streamed(self.means, self.stds, kernels), FEATURES, ["_seen", *response_names()], SEQUENCE_ROWS - 1, keep=keep)

    def _with_vector(self, windows: DataFrame) -> DataFrame:
        own = Scaler(self.means, self.stds).columns()
        return windows.withColumn(VECTOR, _vector([*own, *[F.col(c) for c in response_names()]]))

    def fit(self, rows: DataFrame, classes: list[str]) -> None:
        self.classes = classes
        self.means, self.stds = moments(rows, FEATURES)
        series = counted_series(rows, ["fault_type", *FEATURES])
        keep = ["fault_type", *FEATURES, COUNT, "_seen", *response_names()]
        whole = cut_lineage(self._windows(series, keep).filter(F.col("_seen") >= SEQUENCE_ROWS))
        if whole.isEmpty():
            raise ValueError("training data has no complete sequence window")
        weight = F.create_map(*[F.lit(v) for pair in class_weights(whole).items() for v in pair])[F.col("fault_type")]
        data = self._with_vector(whole).select(
            VECTOR, label_index(F.col("fault_type"), classes).alias(LABEL), (weight * F.col(COUNT)).alias(WEIGHT))
        options = {"maxIter": 100, "regParam": 1e-3, **self.options}
        self.model = LogisticRegression(featuresCol=VECTOR, labelCol=LABEL, weightCol=WEIGHT, family="multinomial", **options).fit(data)

    def probabilities(self, rows: DataFrame) -> DataFrame:
        """Rows before the first whole window take its prediction; a shorter series
        takes that of its one padded window."""
        scored = self.model.transform(self._with_vector(self._windows(rows)))
        # Classes none of whose series has a whole window are unknown to the head beyond the last one it saw.
        known = F.concat(vector_to_array("probability"), F.array_repeat(F.lit(0.0), len(self.classes)))
        scored = computed_once(scored, {"_p": F.slice(known, 1, len(self.classes))}).drop(
            VECTOR, "rawPrediction", "prediction", *response_names())
        whole = scored.withColumn("probability", F.when(F.col("_seen") >= SEQUENCE_ROWS, F.col("_p")))
        return pad_head(whole, "probability", last="_p").drop("_seen", "_p")

    def models(self) -> dict[str, Model]:
        return {"model": self.model}

    def take(self, models: dict[str, Model]) -> None:
        self.model = models["model"]

    def state(self) -> dict[str, Any]:
        return {**super().state(), "means": self.means, "stds": self.stds}

    def restore(self, state: dict[str, Any]) -> None:
        super().restore(state)
        self.means, self.stds = state["means"], state["stds"]


BACKENDS = {b.kind: b for b in (ForestBackend, BoostedBackend, CascadeBackend, NeuralBackend, GraphBackend, SequenceBackend)}
_READERS = {
    "LogisticRegressionModel": LogisticRegressionModel,
    "MultilayerPerceptronClassificationModel": MultilayerPerceptronClassificationModel,
}


def save_models(backend: Backend, path: str) -> dict[str, str]:
    """Write the backend's models; returns their classes by name."""
    kinds = {}
    for name, model in backend.models().items():
        model.write().overwrite().save(f"{path}/{name}")
        kinds[name] = type(model).__name__
    return kinds


def load_models(path: str, kinds: dict[str, str]) -> dict[str, Model]:
    return {name: _READERS[kind].load(f"{path}/{name}") for name, kind in kinds.items()}
