"""Unsupervised detectors, all trained on normal rows only."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airsleuth.detectors.base import ScoreDetector
from airsleuth.detectors.mixture import KINDS, START_ROWS, Mixture, fit_mixture, log_parts, log_total, start
from airsleuth.detectors.runs import counted_runs, for_each_run
from airsleuth.detectors.splines import DEGREE, curves, design, knots_of
from airsleuth.detectors.sums import summed
from airsleuth.errors import FeatureEngineeringError
from airsleuth.functions.columns import complete
from airsleuth.functions.quantiles import exact_quantiles, moments
from airsleuth.operators.splits import complete_rows, normal_rows, sample_at_most
from airsleuth.schema import FEATURES, ROW_KEYS, SEQ
from airsleuth.session import cut_lineage

SAMPLE_IDS = [*ROW_KEYS, SEQ]


class Scaler:
    """Standardization with means and population deviations of the training rows."""

    def __init__(self, means: list[float], stds: list[float]) -> None:
        self.means, self.stds = means, stds

    @classmethod
    def of(cls, df: DataFrame) -> Scaler:
        means, stds = moments(df, FEATURES)
        if means[0] is None:
            raise FeatureEngineeringError("no complete normal rows to train on")
        return cls(means, stds)

    def columns(self) -> list[Column]:
        return [(F.col(c) - m) / s for c, m, s in zip(FEATURES, self.means, self.stds)]

    def array(self) -> Column:
        return F.array(*self.columns())

    def batch(self, rows: pd.DataFrame) -> np.ndarray:
        return (rows.to_numpy(dtype=float) - np.array(self.means)) / np.array(self.stds)

    def state(self) -> dict[str, list[float]]:
        return {"means": self.means, "stds": self.stds}


def covariance(df: DataFrame, scaler: Scaler) -> np.ndarray:
    """Covariance of the standardized features of the training rows, from one sum of products with a leading 1."""
    n = len(FEATURES) + 1

    def products(rows: pd.DataFrame, counts: np.ndarray) -> np.ndarray:
        x = np.column_stack([np.ones(len(rows)), scaler.batch(rows)])
        return (x * counts[:, None]).T @ x

    sums = summed(df, products, (n, n))
    matrix = sums[1:, 1:] / max(sums[0, 0], 1.0)
    return (matrix + matrix.T) / 2


def once_per_row(score: Callable[[Column], Column]) -> Column:
    """A scoring function on the feature row. Marked as not repeatable, so that Spark
    does not run it once for the condition on the score and again for its value."""
    return score.asNondeterministic()(F.struct(*FEATURES))


class MixtureDetector(ScoreDetector):
    """Gaussian mixture; the score is the negative log-likelihood.

    ``covariance`` is 'full', 'tied', 'diag' or 'spherical', for any number of ``components``. One component
    has a closed form; with ``'diag'`` it also scores in built-in expressions.
    """

    signal = "gmm_nll_score"
    source = "gmm_detector"
    RIDGE = 1e-3

    def __init__(self, components: int = 5, covariance: str = "full", max_iter: int = 100, seed: int = 42) -> None:
        super().__init__()
        if covariance not in KINDS or components < 1:
            raise ValueError(f"covariance must be one of {KINDS}, components at least 1")
        self.components, self.covariance, self.max_iter, self.seed = components, covariance, max_iter, seed
        self.scaler: Scaler | None = None
        self.weights: list[float] = []
        self.centers: list[list[float]] = []
        self.covariances: list[list[list[float]]] = []

    def fit(self, df: DataFrame) -> MixtureDetector:
        normals = cut_lineage(
            complete_rows(normal_rows(df)).select(*SAMPLE_IDS, *FEATURES)
        )
        self.scaler = Scaler.of(normals)
        if not self._closed():
            sample = sample_at_most(normals, START_ROWS, SAMPLE_IDS, self.seed).orderBy(*SAMPLE_IDS).select(*FEATURES).toPandas()
            first = start(self.scaler.batch(sample), self.components, self.covariance, self.seed)
            # With one component the first step is exact.
            counted = cut_lineage(counted_runs(normals, FEATURES))
            found = fit_mixture(counted, self.scaler.batch, first, self.covariance, self.RIDGE, 1 if self.components == 1 else self.max_iter)
            self.weights, self.centers, self.covariances = (a.tolist() for a in found)
        self.set_thresholds(normals)
        return self

    def _closed(self) -> bool:
        """Whether standardizing alone tells all."""
        return self.components == 1 and self.covariance == "diag"

    def score(self, df: DataFrame) -> DataFrame:
        rows = df.filter(complete(FEATURES))
        return rows.withColumn("score", self._diagonal() if self._closed() else self._mixture())

    def _diagonal(self) -> Column:
        """Standardized training rows have unit variance, to which the ridge is added."""
        variance = 1.0 + self.RIDGE
        square = sum((z * z for z in self.scaler.columns()[1:]), self.scaler.columns()[0] ** 2)
        return 0.5 * (square / variance + len(FEATURES) * float(np.log(2 * np.pi * variance)))

    def _mixture(self) -> Column:
        scaler, ridge = self.scaler, self.RIDGE
        mixture = Mixture(np.array(self.weights), np.array(self.centers), np.array(self.covariances))

        @F.pandas_udf("double")
        def negative_log_likelihood(rows: pd.DataFrame) -> pd.Series:
            return pd.Series(for_each_run(scaler.batch(rows), lambda x: -log_total(log_parts(x, mixture, ridge))))

        return once_per_row(negative_log_likelihood)

    def parameters(self) -> dict[str, Any]:
        return {
            "components": self.components, "covariance": self.covariance, "scaler": self.scaler.state(),
            "weights": self.weights, "centers": self.centers, "covariances": self.covariances,
        }

    def restore(self, parameters: dict[str, Any]) -> None:
        self.components, self.covariance = parameters["components"], parameters["covariance"]
        self.scaler = Scaler(**parameters["scaler"])
        self.weights, self.centers = parameters["weights"], parameters["centers"]
        self.covariances = parameters["covariances"]


class ReconstructionDetector(ScoreDetector):
    """Distance from curves through the normal rows: mean squared reconstruction error.

    A row is encoded by its coordinates on the eigenvectors of the covariance that hold 95 % of the variance,
    and decoded by additive cubic B-splines of them, fitted by least squares from one sum of normal
    equations over all normal rows. With straight lines only that is the distance from the axes.
    """

    policy = "RECONSTRUCTION_ERROR"
    signal = "kan_mse"
    source = "kan_autoencoder"
    percentiles = (0.95, 0.99)
    VARIANCE_KEPT = 0.95
    #: Shares of normal rows below the first and the last knot.
    ENDS = (0.005, 0.995)

    def __init__(self, seed: int = 42) -> None:
        super().__init__()
        self.seed = seed
        self.scaler: Scaler | None = None
        self.axes: list[list[float]] = []
        self.knots: list[list[float]] = []
        self.curves: list[list[float]] = []

    def fit(self, df: DataFrame) -> ReconstructionDetector:
        normals = cut_lineage(
            complete_rows(normal_rows(df)).select(*SAMPLE_IDS, *FEATURES)
        )
        self.scaler = Scaler.of(normals)
        counted = cut_lineage(counted_runs(normals, FEATURES))
        variances, axes = np.linalg.eigh(covariance(counted, self.scaler))
        shares = np.cumsum(variances[::-1]) / max(variances.sum(), 1e-12)
        kept = min(int(np.searchsorted(shares, self.VARIANCE_KEPT)) + 1, len(FEATURES))
        axes = axes[:, ::-1][:, :kept]
        self.axes = axes.tolist()
        z = [sum((c * float(w) for c, w in zip(self.scaler.columns(), axis)), F.lit(0.0)) for axis in axes.T]
        ends = normals.select(*[c.alias(f"z{i}") for i, c in enumerate(z)]).agg(
            *[F.percentile_approx(f"z{i}", list(self.ENDS)) for i in range(kept)]).first()
        knots = np.array([knots_of(*e) for e in ends])
        scaler, n = self.scaler, 1 + kept + knots.shape[0] * (knots.shape[1] - DEGREE - 1)

        def products(rows: pd.DataFrame, counts: np.ndarray) -> np.ndarray:
            x = scaler.batch(rows)
            phi = design(x @ axes, knots)
            return (phi * counts[:, None]).T @ np.hstack([phi, x])

        sums = summed(counted, products, (n, n + len(FEATURES)))
        self.knots, self.curves = knots.tolist(), curves(sums[:, :n], sums[:, n:], sums[0, 0]).tolist()
        self.set_thresholds(normals)
        return self

    def score(self, df: DataFrame) -> DataFrame:
        scaler, axes, knots, coefficients = self.scaler, np.array(self.axes), np.array(self.knots), np.array(self.curves)

        @F.pandas_udf("double")
        def squared_error(rows: pd.DataFrame) -> pd.Series:
            return pd.Series(for_each_run(scaler.batch(rows), lambda x: ((x - design(x @ axes, knots) @ coefficients) ** 2).mean(axis=1)))

        return df.filter(complete(FEATURES)).withColumn("score", once_per_row(squared_error))

    def parameters(self) -> dict[str, Any]:
        return {"scaler": self.scaler.state(), "axes": self.axes, "knots": self.knots, "curves": self.curves}

    def restore(self, parameters: dict[str, Any]) -> None:
        self.scaler, self.axes = Scaler(**parameters["scaler"]), parameters["axes"]
        self.knots, self.curves = parameters["knots"], parameters["curves"]


def _path_length(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    general = 2.0 * (np.log(big - 1.0) + np.euler_gamma) - 2.0 * (big - 1.0) / big
    return np.where(n > 2, general, np.where(n == 2, 1.0, 0.0))


def _grow_tree(sample: pd.DataFrame, seed: int) -> pd.DataFrame:
    """One isolation tree: random splits until points are alone or the depth is reached."""
    tree = int(sample["tree"].iloc[0])
    random = np.random.default_rng([seed, tree])
    points = sample.sort_values(SAMPLE_IDS)[FEATURES].to_numpy(dtype=float)
    deepest = int(np.ceil(np.log2(max(len(points), 2))))
    nodes: list[list[float]] = []
    todo = [(points, 0, -1, 0)]
    while todo:
        here, depth, parent, side = todo.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][2 + side] = me
        low, high = here.min(axis=0), here.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= deepest or len(here) < 2 or len(usable) == 0:
            nodes.append([-1, 0.0, -1, -1, depth + float(_path_length(len(here)))])
            continue
        feature = int(random.choice(usable))
        threshold = float(random.uniform(low[feature], high[feature]))
        nodes.append([feature, threshold, -1, -1, 0.0])
        left = here[:, feature] <= threshold
        todo.append((here[~left], depth + 1, me, 1))
        todo.append((here[left], depth + 1, me, 0))
    table = pd.DataFrame(nodes, columns=["feature", "threshold", "left", "right", "depth"])
    return table.assign(tree=tree, node=range(len(nodes))).astype(
        {"feature": int, "left": int, "right": int, "node": int}
    )


class IsolationForestDetector(ScoreDetector):
    """Isolation forest; the score is 2 ** (-mean depth / expected depth)."""

    signal = "isolation_forest_score"
    source = "isolation_forest"
    percentiles = (0.95, 0.99)

    def __init__(self, trees: int = 100, contamination: float = 0.05, seed: int = 42, tree_rows: int = 256) -> None:
        """``tree_rows``: rows each tree is grown on, a parameter of the method."""
        super().__init__()
        self.trees, self.contamination, self.seed, self.tree_rows = trees, contamination, seed, tree_rows
        self.scaler: Scaler | None = None
        self.nodes: list[dict[str, list]] = []
        self.sample_rows = 0
        self.flag_from = 0.0

    def fit(self, df: DataFrame) -> IsolationForestDetector:
        """Each tree grows in a task of its own on ``tree_rows`` rows of a bounded sample."""
        normals = cut_lineage(complete_rows(normal_rows(df)).select(*SAMPLE_IDS, *FEATURES))
        self.scaler = Scaler.of(normals)
        scaled = normals.select(*SAMPLE_IDS, *[z.alias(c) for c, z in zip(FEATURES, self.scaler.columns())])
        pool = cut_lineage(sample_at_most(scaled, self.trees * self.tree_rows, SAMPLE_IDS, self.seed))
        size = pool.count()
        self.sample_rows = min(size, self.tree_rows)
        self.nodes = self._grow(pool, size)
        self.fitted = True
        scores = cut_lineage(self.score(normals).select("score"))
        self.warning, self.critical, self.flag_from = exact_quantiles(
            scores, "score", [*self.percentiles, 1.0 - self.contamination]
        )
        return self

    def _grow(self, pool: DataFrame, size: int) -> list[dict[str, list]]:
        # Rows stand in a ring; tree t takes the ``tree_rows`` rows from place t * ``tree_rows`` on.
        place = F.row_number().over(Window.orderBy(*SAMPLE_IDS)) - 1
        tree = F.explode(F.filter(
            F.sequence(F.lit(0), F.lit(self.trees - 1)),
            lambda t: F.pmod(F.col("place") - t * self.tree_rows, F.lit(size)) < self.sample_rows,
        ))
        seed = self.seed
        grown = (
            pool.withColumn("place", place).select(tree.alias("tree"), *SAMPLE_IDS, *FEATURES)
            .groupBy("tree").applyInPandas(
                lambda rows: _grow_tree(rows, seed),
                "feature int, threshold double, left int, right int, depth double, tree int, node int",
            )
            .orderBy("tree", "node").toPandas()  # at most 511 nodes per tree
        )
        names = ["feature", "threshold", "left", "right", "depth"]
        return [{c: part[c].tolist() for c in names} for _, part in grown.groupby("tree")]

    def score(self, df: DataFrame) -> DataFrame:
        scaler = self.scaler
        forest = [{k: np.array(v) for k, v in tree.items()} for tree in self.nodes]
        expected = max(float(_path_length(self.sample_rows)), 1e-12)

        def scores(x: np.ndarray) -> np.ndarray:
            every = np.arange(len(x))
            total = np.zeros(len(x))
            for tree in forest:
                at = np.zeros(len(x), dtype=int)
                while True:
                    feature = tree["feature"][at]
                    inner = feature >= 0
                    if not inner.any():
                        break
                    left = x[every, np.maximum(feature, 0)] <= tree["threshold"][at]
                    at = np.where(inner, np.where(left, tree["left"][at], tree["right"][at]), at)
                total += tree["depth"][at]
            return 2.0 ** (-total / len(forest) / expected)

        @F.pandas_udf("double")
        def isolation(rows: pd.DataFrame) -> pd.Series:
            return pd.Series(for_each_run(scaler.batch(rows), scores))

        return df.filter(complete(FEATURES)).withColumn("score", once_per_row(isolation))

    def flag(self, scored: DataFrame) -> DataFrame:
        return scored.filter(F.col("score") >= self.flag_from)

    def parameters(self) -> dict[str, Any]:
        return {
            "scaler": self.scaler.state(), "nodes": self.nodes, "sample_rows": self.sample_rows,
            "flag_from": self.flag_from,
        }

    def restore(self, parameters: dict[str, Any]) -> None:
        self.scaler, self.nodes = Scaler(**parameters["scaler"]), parameters["nodes"]
        self.sample_rows, self.flag_from = parameters["sample_rows"], parameters["flag_from"]
