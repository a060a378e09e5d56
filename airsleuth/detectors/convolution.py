"""Dilated causal convolutions over the last rows of a series, as features of a linear head.

Kernels are drawn once from a seed (random convolution kernels, as in the published method of that name): each reads a
few signals at three places that lie 1, 2, 4 or 8 rows apart. Over a row's window of 30 rows a kernel gives its
largest response and the share of responses above its threshold, so what counts is which values stand in which
order. Rows stream in series order; a task holds one batch and 29 rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd

from airsleuth.operators.sequence import SEQUENCE_ROWS

KERNELS = 48
TAPS = 3
SIGNALS = 3
DILATIONS = (1, 2, 4, 8)


class Kernels(NamedTuple):
    """``weights`` is kernels x taps x signals, latest tap first."""

    signals: np.ndarray
    weights: np.ndarray
    dilation: np.ndarray
    threshold: np.ndarray

    @classmethod
    def drawn(cls, width: int, seed: int, kernels: int = KERNELS) -> Kernels:
        draw = np.random.default_rng(seed)
        signals = np.stack([draw.choice(width, min(SIGNALS, width), replace=False) for _ in range(kernels)])
        weights = draw.normal(size=(kernels, TAPS, signals.shape[1]))
        # Half of the kernels see changes only, the others levels too.
        weights[::2] -= weights[::2].mean(axis=1, keepdims=True)
        return cls(signals, weights, np.resize(DILATIONS, kernels), draw.uniform(-1, 1, kernels))


def response_names(kernels: int = KERNELS) -> list[str]:
    return [f"_{what}_{k}" for k in range(kernels) for what in ("most", "above")]


def rows_back(group: np.ndarray, rows: int = SEQUENCE_ROWS) -> np.ndarray:
    """For each row the places of itself and the rows before it in its series; its first row stands for missing ones."""
    at = np.arange(len(group))
    starts = np.r_[True, group[1:] != group[:-1]] if len(group) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(starts, at, 0)) if len(group) else at
    return np.maximum(at[:, None] - np.arange(rows), first[:, None])


def sliding_max(values: np.ndarray, width: int) -> np.ndarray:
    """The largest of each ``width`` values in a row, from maxima of 2, 4, 8 ... values."""
    found, have = values, 1
    while have < width:
        step = min(have, width - have)
        found = np.maximum(found[step:], found[:len(found) - step])
        have += step
    return found


def responses(values: np.ndarray, group: np.ndarray, kernels: Kernels, rows: int = SEQUENCE_ROWS) -> np.ndarray:
    """Two columns for each kernel, from scaled rows in series order.

    A response at a row is part of all windows that reach it, so each is computed once and windows slide over them.
    """
    out = np.empty((len(values), 2 * len(kernels.dilation)))
    if not len(values):
        return out
    is_start = np.r_[True, group[1:] != group[:-1]]
    # Each series is led by copies of its first row, which stand for missing ones, so no window leaves its series.
    lead = np.repeat(np.flatnonzero(is_start), rows - 1)
    source = np.insert(np.arange(len(values)), lead, lead)
    at = np.arange(len(values)) + (rows - 1) * np.cumsum(is_start)
    for k, (signals, weights, dilation, threshold) in enumerate(zip(*kernels)):
        taps = (values[:, signals] @ weights.T)[source]
        reach = (TAPS - 1) * dilation
        places = rows - reach
        response = sum(taps[reach - j * dilation:len(taps) - j * dilation, j] for j in range(TAPS))
        first = at - (rows - 1)
        above = np.r_[0, np.cumsum(response > threshold)]
        out[:, 2 * k] = sliding_max(response, places)[first]
        out[:, 2 * k + 1] = (above[first + places] - above[first]) / places
    return out


def streamed(means: list[float], stds: list[float], kernels: Kernels):
    """The step for ``stream_series``: rows seen of the window, and the responses."""
    names = response_names(len(kernels.dilation))

    def step(rows: pd.DataFrame, group: np.ndarray) -> dict[str, np.ndarray]:
        scaled = (rows.to_numpy(float) - np.array(means)) / np.array(stds)
        found = responses(scaled, group, kernels)
        seen = pd.Series(group).groupby(group, sort=False).cumcount().to_numpy() + 1
        return {"_seen": np.minimum(seen, SEQUENCE_ROWS).astype(float), **dict(zip(names, found.T))}

    return step
