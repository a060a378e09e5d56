"""EM beside a plain one over all rows at once, and splines on curved data."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from airsleuth.detectors.mixture import KINDS, Mixture, fit_mixture, log_parts, log_total, start
from airsleuth.detectors.scores import MixtureDetector, ReconstructionDetector
from airsleuth.detectors.splines import basis, design, knots_of
from airsleuth.schema import FEATURES, NORMAL
from airsleuth.session import cut_lineage
from tests.frames import separable_frame


def _plain_em(x: np.ndarray, first: Mixture, kind: str, ridge: float, rounds: int) -> Mixture:
    """Row by row responsibilities, textbook updates."""
    weights, centers, covariances = (a.copy() for a in first)
    n, d = x.shape
    for _ in range(rounds):
        density = np.array([[w * np.exp(-0.5 * (row - m) @ np.linalg.inv(c + ridge * np.eye(d)) @ (row - m)) / np.sqrt(np.linalg.det(2 * np.pi * (c + ridge * np.eye(d))))
                             for w, m, c in zip(weights, centers, covariances)] for row in x])
        share = density / density.sum(axis=1, keepdims=True)
        size = share.sum(axis=0)
        weights, centers = size / n, (share.T @ x) / size[:, None]
        spread = [((share[:, [k]] * (x - centers[k])).T @ (x - centers[k])) for k in range(len(size))]
        if kind == "tied":
            covariances = np.array([sum(spread) / n] * len(size))
        else:
            each = [s / z for s, z in zip(spread, size)]
            covariances = np.array([{"full": s, "diag": np.diag(np.diag(s)), "spherical": np.eye(d) * np.diag(s).mean()}[kind] for s in each])
    return Mixture(weights, centers, covariances)


@pytest.fixture(scope="module")
def clouds(spark):
    """Three clouds in the first features; the others hardly move."""
    draw = np.random.default_rng(8)
    x = draw.normal(0, 0.3, (300, len(FEATURES)))
    x[:, :2] += np.repeat([[0, 0], [3, 0], [0, 4]], 100, axis=0) + draw.normal(0, 1, (300, 1)) * [0.5, 0.5]
    return x, cut_lineage(spark.createDataFrame(pd.DataFrame(x, columns=FEATURES)).repartition(4))


@pytest.mark.parametrize("kind", KINDS)
def test_em_equals_a_plain_one(clouds, kind):
    x, rows = clouds
    first = start(x, 3, kind, 1)
    got = fit_mixture(rows, lambda r: r.to_numpy(float), first, kind, 1e-2, 3)
    for a, b in zip(got, _plain_em(x, first, kind, 1e-2, 3)):
        assert np.allclose(a, b, atol=1e-8)
    assert np.isfinite(log_total(log_parts(x, got, 1e-2))).all()


def test_kinds_are_checked():
    for bad in ({"covariance": "round"}, {"components": 0}):
        with pytest.raises(ValueError):
            MixtureDetector(**bad)


def test_splines_sum_to_one_and_are_local():
    knots = knots_of(-1.0, 3.0)
    z = np.linspace(-5, 6, 200)
    b = basis(z, knots)
    assert b.shape == (200, 8) and np.allclose(b.sum(axis=1), 1) and (b >= -1e-12).all() and ((b > 1e-12).sum(axis=1) <= 4).all()
    inside = (z > -1) & (z < 3)
    cubic = z[inside] ** 3 - z[inside]
    fit = np.linalg.lstsq(b[inside], cubic, rcond=None)[0]
    assert np.allclose(b[inside] @ fit, cubic)


def test_curved_normals_come_closer_than_straight_axes(spark):
    """Signals that follow one driver along curves: straight axes leave what the splines take."""
    draw = np.random.default_rng(4)
    frame = separable_frame()
    frame = frame[frame["fault_type"] == NORMAL]
    t = draw.uniform(-1, 1, len(frame))
    shapes = np.column_stack([np.sin(1.2 * t) + 0.01 * i if i % 3 else 4 * t ** 2 for i in range(len(FEATURES))])
    frame = frame.assign(**dict(zip(FEATURES, (shapes + draw.normal(0, 0.02, shapes.shape)).T)))
    rows = cut_lineage(spark.createDataFrame(frame))
    detector = ReconstructionDetector()
    detector.VARIANCE_KEPT = 0.5
    detector.fit(rows)
    axes, x = np.array(detector.axes), detector.scaler.batch(frame[FEATURES])
    straight = ((x - x @ axes @ axes.T) ** 2).mean()
    scores = detector.score(rows).select("score").toPandas()["score"]
    assert axes.shape[1] < 5 and scores.mean() < 0.5 * straight
    phi = design(x @ axes, np.array(detector.knots))
    best = np.linalg.lstsq(phi, x, rcond=None)[0]
    assert scores.mean() == pytest.approx(((x - phi @ best) ** 2).mean(), rel=0.05)
