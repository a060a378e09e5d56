"""Exact quantiles that no single task has to hold the data for."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACCURACY = 10_000


def exact_quantiles(df: DataFrame, column: str, probabilities: Sequence[float],
                    accuracy: int = ACCURACY) -> list[float] | None:
    """Quantiles with linear interpolation; nulls do not count; None without values.

    The built-in exact percentile keeps every distinct value in one task. Here
    approximate quantiles bracket each rank and ranks are counted exactly, the
    same way for any number of rows. ``accuracy`` decides how fast brackets shrink.
    """
    values = df.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull())
    rows = values.count()
    if rows == 0:
        return None
    places = [p * (rows - 1) for p in probabilities]
    ranks = sorted({r for p in places for r in (math.floor(p), math.ceil(p))})
    v, known = F.col("v"), {}
    # Where the sketch was right, one look at all ranks is enough.
    guesses = values.agg(F.percentile_approx("v", [(r + 0.5) / rows for r in ranks], accuracy)).first()[0]
    seen = values.agg(*[c for x in guesses for c in (F.count_if(v < x), F.count_if(v == x))]).first()
    for rank, guess, under, equal in zip(ranks, guesses, seen[::2], seen[1::2]):
        known[rank] = guess if under <= rank < under + equal else _nth(values, rank, rows, accuracy)
    return [known[math.floor(p)] + (known[math.ceil(p)] - known[math.floor(p)]) * (p - math.floor(p)) for p in places]


def _nth(values: DataFrame, place: int, rows: int, accuracy: int) -> float:
    """The value at a place in order, from 0.

    Each round takes two values of the data near the place and keeps the part
    below, between or above them, so what is left always gets smaller.
    """
    v, inside, below, count = F.col("v"), values, 0, rows
    while True:
        share, margin = (place - below) / max(1, count - 1), 2 / accuracy
        bounds = [max(0.0, share - margin), min(1.0, share + margin)]
        a, b = inside.agg(F.percentile_approx("v", bounds, accuracy)).first()[0]
        under, at_a, between, at_b = inside.agg(
            F.count_if(v < a), F.count_if(v == a), F.count_if((v > a) & (v < b)), F.count_if((v == b) & (v > a))).first()
        here = place - below
        if here < under:
            inside, count = inside.filter(v < a), under
        elif here < under + at_a:
            return a
        elif here < under + at_a + between:
            inside, below, count = inside.filter((v > a) & (v < b)), below + under + at_a, between
        elif here < under + at_a + between + at_b:
            return b
        else:
            passed = under + at_a + between + at_b
            inside, below, count = inside.filter(v > b), below + passed, count - passed


def moments(df: DataFrame, columns: Sequence[str]) -> tuple[list[float], list[float]]:
    """Means and population deviations of columns, in one aggregate; a deviation of 0 becomes 1."""
    row = df.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    n = len(columns)
    return list(row[:n]), [s if s else 1.0 for s in row[n:]]
