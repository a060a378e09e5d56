"""Equal rows that follow one another, worked on once and counted: zones copy what their air handler measures."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airsleuth.operators.ordered import Order, join_null_safe
from airsleuth.operators.splits import MOST_CONSTANTS, with_lookup
from airsleuth.session import cut_lineage

#: How many rows a row of a counted table stands for.
COUNT = "_rows"
#: Different counts up to which their common divisor is looked for.
MOST_COUNTS = 1_000


def run_starts(columns: Sequence[np.ndarray]) -> np.ndarray:
    """Whether each row differs from the one before it; NaN is unlike itself, so its rows stay apart."""
    starts = np.ones(len(columns[0]), bool)
    starts[1:] = False
    for values in columns:
        starts[1:] |= values[1:] != values[:-1]
    return starts


def run_lengths(starts: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[np.flatnonzero(starts), len(starts)])


def for_each_run(values: np.ndarray, work) -> np.ndarray:
    """``work`` on the first row of each run of equal rows, its result given to all of them."""
    if not len(values):
        return work(values)
    starts = run_starts(values.T)
    return work(values[starts])[np.cumsum(starts) - 1]


def counted_runs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``columns`` of runs of equal rows, and how many rows each stands for.

    Equal rows that lie apart are counted apart, so counts times rows are those of ``df`` in whatever order it
    comes. A task holds one batch and the run that may go on in the next.
    """
    columns = list(columns)

    def counted(batch: pa.RecordBatch, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], names=[*columns, COUNT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = run_starts([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            places, counts = np.flatnonzero(starts), run_lengths(starts)
            if last is not None:
                ends = pa.Table.from_batches([last[0], batch.slice(0, 1)])
                if run_starts([c.to_numpy() for c in ends.columns])[1]:
                    yield counted(last[0], [last[1]])
                else:
                    counts[0] += last[1]
            yield counted(batch.take(pa.array(places[:-1])), counts[:-1])
            last = batch.slice(places[-1], 1), counts[-1]
        if last is not None:
            yield counted(last[0], [last[1]])

    picked = df.select(*columns)
    return picked.mapInArrow(run, T.StructType([*picked.schema.fields, T.StructField(COUNT, T.LongType())]))


def counted_series(df: DataFrame, columns: Sequence[str], order: Order = Order()) -> DataFrame:
    """One of all series that have the same rows, in order columns and ``columns``, and how many series it stands for.

    Whether rows are the same is told by their number and 126 bits of their hashes, added up by series.
    """
    keys, row = list(order.keys), F.xxhash64(*order.columns, *columns)
    sums = [F.sum(row.bitwiseAND(F.lit(0x7FFFFFFF))), F.sum(F.shiftrightunsigned(row, 33))]
    alike = {f"_alike_{i}": c for i, c in enumerate([F.count("*"), F.bit_xor(row), *sums])}
    firsts = cut_lineage(
        df.groupBy(*keys).agg(*[c.alias(n) for n, c in alike.items()])
        .groupBy(*alike).agg(F.min(F.struct(*keys)).alias("_first"), F.count("*").alias(COUNT)).select("_first.*", COUNT))
    if firsts.count() <= MOST_CONSTANTS:
        return with_lookup(df, firsts, keys, COUNT).filter(F.col(COUNT).isNotNull())
    return join_null_safe(df, firsts, keys, "inner")


def fewest_copies(counted: DataFrame) -> DataFrame:
    """Each row as often as its count divided by what divides all counts: the same shares in the fewest rows."""
    counts = [r[0] for r in counted.select(COUNT).distinct().limit(MOST_COUNTS + 1).collect()]
    common = math.gcd(*counts) if len(counts) <= MOST_COUNTS else 1
    if counts == [common]:
        return counted.drop(COUNT)
    copies = F.array_repeat(F.lit(0), (F.col(COUNT) / common).cast("int"))
    return counted.withColumn(COUNT, F.explode(copies)).drop(COUNT)
