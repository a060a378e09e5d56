"""Control errors, temperature deltas, rolling statistics and lags."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

import numpy as np
import pandas as pd
from pandas.api.indexers import BaseIndexer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airsleuth.errors import FeatureEngineeringError
from airsleuth.operators.ordered import MAX_ROWS, SLICE, Order, stream_series, with_run_up
from airsleuth.operators.reshape import copy_to_zones, normalize_wide, numbers
from airsleuth.schema import (
    DIFFERENCES, LAG_COLUMNS, POWER_COLUMN, POWER_WINDOW, ROLLING_COLUMNS, ROLLING_WINDOWS,
    SCENARIO, TIME, ZONE, require_columns,
)

# (column, rows in the frame) of every rolling mean and deviation
FRAMES = [(c, n) for c in ROLLING_COLUMNS for n in ROLLING_WINDOWS] + [(POWER_COLUMN, POWER_WINDOW)]
ROLLING_OUTPUTS = [f"{c}_{n}_{s}" for c, n in FRAMES for s in ("mean", "std")]
LAG_OUTPUTS = [f"{c}_lag1" for c in LAG_COLUMNS]
SERIES_INPUTS = list(dict.fromkeys([*ROLLING_COLUMNS, POWER_COLUMN, *LAG_COLUMNS]))
LONGEST = max(n for _, n in FRAMES)
INPUTS = list(dict.fromkeys([c for pair in DIFFERENCES.values() for c in pair] + [POWER_COLUMN]))


def control_errors(df: DataFrame) -> DataFrame:
    """Actual minus demand, and temperature deltas."""
    require_columns(df, INPUTS, FeatureEngineeringError)
    return df.withColumns({name: F.col(a) - F.col(b) for name, (a, b) in DIFFERENCES.items()})


def _frame(n: int, order: Order) -> Window:
    return Window.partitionBy(*order.by_slice).orderBy(*order.columns).rowsBetween(1 - n, 0)


def rolling_mean(column: str, n: int, order: Order = Order()) -> Column:
    """Mean of the last ``n`` rows, this one included; nulls do not count."""
    return F.avg(column).over(_frame(n, order))


def rolling_std(column: str, n: int, order: Order = Order()) -> Column:
    """Sample deviation over the last ``n`` rows; 0 while there are fewer than two values."""
    return F.coalesce(F.stddev_samp(column).over(_frame(n, order)), F.lit(0.0))


def lag_one(column: str, order: Order = Order()) -> Column:
    return F.lag(column, 1).over(Window.partitionBy(*order.by_slice).orderBy(*order.columns))


def add_windows(df: DataFrame, columns: dict[str, tuple[str, str, int]], order: Order = Order(),
                max_rows: int | None = MAX_ROWS) -> DataFrame:
    """A few window columns with built-in frames.

    ``columns`` maps an output name to (kind, column, rows), kind being mean,
    std or lag. All share one partitioning and one sort.
    """
    build = {"mean": rolling_mean, "std": rolling_std, "lag": lambda c, n, o: lag_one(c, o)}
    back = max(1 if kind == "lag" else n - 1 for kind, _, n in columns.values())
    framed = with_run_up(df, back, order, max_rows)
    out = framed.select("*", *[build[k](c, n, order).alias(name) for name, (k, c, n) in columns.items()])
    return out.filter(~F.col("_copy")).drop("_copy", SLICE)


class _InSeries(BaseIndexer):
    """Frames of the last rows that begin no earlier than their series does (``begin``, for each row)."""

    def get_window_bounds(self, num_values=0, min_periods=None, center=None, closed=None, step=None):
        end = np.arange(1, num_values + 1, dtype=np.int64)
        return np.maximum(self.begin, end - self.window_size), end


def _roll(values: pd.DataFrame, group: np.ndarray, wanted: Sequence[str] = (*ROLLING_OUTPUTS, *LAG_OUTPUTS)) -> dict[str, np.ndarray]:
    """The ``wanted`` rolling columns and lags of rows that lie in series order.

    Frames are told by their bounds: the rolling of a grouped frame steps through the same
    ones, bit by bit, but spends more than half of its time on groups and their index.
    """
    out = {}
    starts = np.r_[True, group[1:] != group[:-1]]
    begin = np.maximum.accumulate(np.where(starts, np.arange(len(group)), 0))
    for n in ROLLING_WINDOWS:
        for what in ("mean", "std"):
            columns = [c for c, width in FRAMES if width == n and f"{c}_{n}_{what}" in wanted]
            if not columns:
                continue
            frames = values[columns].rolling(_InSeries(window_size=n, begin=begin), min_periods=1)
            found = frames.mean() if what == "mean" else frames.std().fillna(0.0)
            for c in columns:
                out[f"{c}_{n}_{what}"] = found[c].to_numpy()
    for c in LAG_COLUMNS:
        if f"{c}_lag1" in wanted:
            out[f"{c}_lag1"] = values[c].shift(1).mask(starts).to_numpy()
    return out


def add_features(df: DataFrame, order: Order = Order(), max_rows: int | None = MAX_ROWS,
                 keep: Sequence[str] | None = None) -> DataFrame:
    """All 54 engineered columns behind the input's own columns, or those of both in ``keep``.

    44 bounded frames as built-in windows evaluate each frame afresh for each
    row, which took several times as long as streaming the sorted rows through
    one rolling step in Arrow batches.
    """
    rows = numbers(control_errors(df), SERIES_INPUTS)
    outputs = [c for c in [*ROLLING_OUTPUTS, *LAG_OUTPUTS] if keep is None or c in keep]
    read = {c for c, n in FRAMES for s in ("mean", "std") if f"{c}_{n}_{s}" in outputs} | {c for c in LAG_COLUMNS if f"{c}_lag1" in outputs}
    return stream_series(
        rows, partial(_roll, wanted=outputs), [c for c in SERIES_INPUTS if c in read], outputs, LONGEST - 1, order, max_rows, keep
    )


def build_features(long: DataFrame, order: Order = Order(), max_rows: int | None = MAX_ROWS,
                   keep: Sequence[str] | None = None) -> DataFrame:
    """Features of normalized rows, one series per (scenario, zone)."""
    require_columns(long, [*INPUTS, TIME, ZONE], FeatureEngineeringError)
    return add_features(long, order, max_rows, keep)


def build_features_from_wide(wide: DataFrame, max_rows: int | None = MAX_ROWS) -> DataFrame:
    """Features of raw wide rows: one series per scenario, then copied to its zones."""
    return copy_to_zones(wide_features(wide, max_rows))


def wide_features(wide: DataFrame, max_rows: int | None = MAX_ROWS, keep: Sequence[str] | None = None) -> DataFrame:
    """Features of raw wide rows before they are copied to the zones; a fifth of what is to be kept of them."""
    return add_features(normalize_wide(wide), Order(keys=(SCENARIO,)), max_rows, keep)
