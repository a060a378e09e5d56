"""Expectation-maximisation for Gaussian mixtures with four kinds of covariance, one aggregate for each iteration."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from airsleuth.detectors.sums import summed

KINDS = ("full", "tied", "diag", "spherical")
#: Rows, in the order of a hash, that the first centres are chosen from.
START_ROWS = 2_000
#: EM ends when the mean log-likelihood gains less.
TOLERANCE = 1e-3


class Mixture(NamedTuple):
    """Covariances are matrices whatever their kind."""

    weights: np.ndarray
    centers: np.ndarray
    covariances: np.ndarray


def log_parts(x: np.ndarray, mixture: Mixture, ridge: float) -> np.ndarray:
    """Log of weight times density, one column for each component; the ridge keeps collinear features positive definite."""
    out = np.empty((len(x), len(mixture.weights)))
    for k, (weight, center, covariance) in enumerate(zip(*mixture)):
        lower = np.linalg.cholesky(covariance + ridge * np.eye(len(center)))
        z = np.linalg.solve(lower, (x - center).T)
        out[:, k] = np.log(max(weight, 1e-300)) - np.log(np.diag(lower)).sum() - 0.5 * (len(center) * np.log(2 * np.pi) + (z ** 2).sum(axis=0))
    return out


def log_total(parts: np.ndarray) -> np.ndarray:
    top = parts.max(axis=1, keepdims=True)
    return (top + np.log(np.exp(parts - top).sum(axis=1, keepdims=True)))[:, 0]


def expected(x: np.ndarray, mixture: Mixture, ridge: float, counts: np.ndarray) -> np.ndarray:
    """Sums of responsibilities: for each component its share, weighted rows and weighted products, and the log-likelihood.

    A row counts as often as ``counts`` says.
    """
    parts = log_parts(x, mixture, ridge)
    total = log_total(parts)
    share = np.exp(parts - total[:, None]) * counts[:, None]
    k, d = mixture.centers.shape
    out = np.zeros((k, 2 + d + d * d))
    out[:, 0] = share.sum(axis=0)
    out[0, 1] = total @ counts
    out[:, 2:2 + d] = share.T @ x
    for i in range(k):
        out[i, 2 + d:] = ((x * share[:, [i]]).T @ x).ravel()
    return out


def maximised(sums: np.ndarray, kind: str, before: Mixture) -> Mixture:
    """Weights, centres and covariances from the sums; a component without rows stays as it was, with weight 0."""
    k, d = before.centers.shape
    share = sums[:, 0]
    known = share > 1e-9
    size = np.where(known, share, 1.0)
    centers = np.where(known[:, None], sums[:, 2:2 + d] / size[:, None], before.centers)
    products = sums[:, 2 + d:].reshape(k, d, d)
    spread = products / size[:, None, None] - centers[:, :, None] * centers[:, None, :]
    if kind == "tied":
        shared = (spread[known] * share[known][:, None, None]).sum(axis=0) / share.sum()
        spread = np.repeat(shared[None], k, axis=0)
    spread = of_kind(spread, kind)
    covariances = np.where(known[:, None, None] | (kind == "tied"), (spread + spread.transpose(0, 2, 1)) / 2, before.covariances)
    # Rounding can leave variances of constant features below 0.
    every = np.arange(d)
    covariances[:, every, every] = np.maximum(covariances[:, every, every], 0.0)
    return Mixture(share / share.sum(), centers, covariances)


def of_kind(spread: np.ndarray, kind: str) -> np.ndarray:
    """Covariances with what their kind does not have set to 0 or to the mean."""
    every = np.eye(spread.shape[-1])
    if kind == "spherical":
        return np.trace(spread, axis1=1, axis2=2)[:, None, None] / len(every) * every
    return spread * every if kind == "diag" else spread


def start(sample: np.ndarray, components: int, kind: str, seed: int) -> Mixture:
    """Centres far from one another (k-means++), covariances of the whole sample in their kind, equal weights.

    A start of another kind would lose likelihood in the first iteration, which looks like the end.
    """
    draw = np.random.default_rng(seed)
    centers = [sample[draw.integers(len(sample))]]
    while len(centers) < components:
        far = np.min([((sample - c) ** 2).sum(axis=1) for c in centers], axis=0)
        centers.append(sample[draw.choice(len(sample), p=far / far.sum() if far.sum() else None)])
    spread = np.cov(sample.T, bias=True).reshape(sample.shape[1], -1)
    return Mixture(np.full(components, 1 / components), np.array(centers), of_kind(np.repeat(spread[None], components, axis=0), kind))


def fit_mixture(normals: DataFrame, scaled, first: Mixture, kind: str, ridge: float, max_iter: int) -> Mixture:
    """EM from a first mixture; ``scaled`` maps a batch of features to scaled rows. Each iteration reads all rows once,
    or all of a table that counts equal ones."""
    if kind not in KINDS:
        raise ValueError(f"covariance must be one of {KINDS}")
    mixture, before = first, -np.inf
    for _ in range(max_iter):
        def of_batch(rows: pd.DataFrame, counts: np.ndarray, now: Mixture = mixture) -> np.ndarray:
            return expected(scaled(rows), now, ridge, counts)

        k, d = mixture.centers.shape
        sums = summed(normals, of_batch, (k, 2 + d + d * d))
        likelihood = sums[0, 1] / sums[:, 0].sum()
        mixture = maximised(sums, kind, mixture)
        if likelihood - before < TOLERANCE:
            break
        before = likelihood
    return mixture
