"""Cubic B-splines of a few coordinates, and the curves through them that come closest to all rows."""

from __future__ import annotations

import numpy as np

DEGREE = 3
#: Splines of a coordinate, besides its straight line.
SPLINES = 8


def knots_of(low: float, high: float, splines: int = SPLINES) -> np.ndarray:
    """Evenly spaced knots so that ``splines`` cubic splines cover ``low`` to ``high``."""
    step = (high - low or 1.0) / (splines - DEGREE)
    return low + step * np.arange(-DEGREE, splines + 1)


def basis(z: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """The splines at each value, one column for each; they sum to 1. Values beyond the knots count as the nearest one within."""
    low, high = knots[DEGREE], knots[-DEGREE - 1]
    z = np.clip(z, low, high - 1e-9 * (high - low))[:, None]
    b = ((z >= knots[:-1]) & (z < knots[1:])).astype(float)
    for p in range(1, DEGREE + 1):
        left = (z - knots[:-p - 1]) / (knots[p:-1] - knots[:-p - 1])
        right = (knots[p + 1:] - z) / (knots[p + 1:] - knots[1:-p])
        b = left * b[:, :-1] + right * b[:, 1:]
    return b


def design(z: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """A row for each row of coordinates: 1, the coordinates, and their splines."""
    return np.hstack([np.ones((len(z), 1)), z, *[basis(z[:, i], k) for i, k in enumerate(knots)]])


def curves(normal: np.ndarray, moments: np.ndarray, rows: float, ridge: float = 1e-6) -> np.ndarray:
    """Coefficients of least squares from sums of products; the ridge decides between splines and the constant, which they sum to."""
    return np.linalg.solve(normal + ridge * rows * np.eye(len(normal)), moments)
