"""Order-dependent work on keyed series, cut into slices of bounded size.

A window over a key puts all rows of that key into one task. Here a key with
many rows is first cut into slices along its order, and each slice is given
copies of the last rows before it, so that frames reaching back a fixed number
of rows see just what they would see in the whole series.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airsleuth.schema import SEQ, SERIES_KEYS, TIME
from airsleuth.session import cut_lineage

SLICE = "_slice"
MAX_ROWS = 250_000


@dataclass(frozen=True)
class Order:
    """Keys of a series and the columns that order its rows; ``seq`` breaks ties of ``time``."""

    keys: tuple[str, ...] = tuple(SERIES_KEYS)
    time: str = TIME
    seq: str = SEQ

    @property
    def columns(self) -> list[str]:
        return [self.time, self.seq]

    @property
    def by_slice(self) -> list[str]:
        return [*self.keys, SLICE]

    def latest_first(self) -> list[Column]:
        return [F.col(c).desc() for c in self.columns]


def _cut(low: Column, high: Column, rows: Column, max_rows: int) -> Column:
    """Width of equal slices that hold half of ``max_rows`` each if rows lie evenly."""
    slices = F.ceil(rows / F.lit(max_rows / 2))
    return F.greatest(F.lit(1), F.ceil((high - low + 1) / slices)).cast("long")


def join_null_safe(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on keys of which some may be null: a null is a key like any other."""
    other = other.withColumnsRenamed({k: f"_other_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_other_{k}")) for k in keys]
    return df.join(other, same, how).drop(*[f"_other_{k}" for k in keys])


def _join_small(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    return join_null_safe(df, F.broadcast(small), keys, how)


def _crowded(sliced: DataFrame, order: Order, max_rows: int) -> DataFrame:
    """Slices of more than ``max_rows`` rows that can be cut, and how to cut them.

    By time into equal parts, with the median instant apart, since rows that
    crowd at one instant would stay together in any part. Where all rows share
    one instant, by the tie-break.
    """
    instant = F.unix_micros(order.time)
    sizes = sliced.groupBy(*order.by_slice).agg(
        F.count("*").alias("_n"),
        F.min(instant).alias("_t_lo"), F.max(instant).alias("_t_hi"),
        F.min(order.seq).alias("_s_lo"), F.max(order.seq).alias("_s_hi"),
        F.percentile_approx(instant, 0.5).alias("_median"),
    )
    by_time = F.col("_t_hi") > F.col("_t_lo")
    return sizes.filter((F.col("_n") > max_rows) & (by_time | (F.col("_s_hi") > F.col("_s_lo")))).select(
        *order.by_slice, by_time.alias("_by_time"), "_median",
        F.when(by_time, F.col("_t_lo")).otherwise(F.col("_s_lo")).alias("_lo"),
        F.when(by_time, _cut(F.col("_t_lo"), F.col("_t_hi"), F.col("_n"), max_rows))
        .otherwise(_cut(F.col("_s_lo"), F.col("_s_hi"), F.col("_n"), max_rows)).alias("_width"),
    )


def _slice(df: DataFrame, order: Order, max_rows: int | None) -> tuple[DataFrame, DataFrame | None]:
    """Rows with ``_slice``, and the keys that were cut (None if no key was)."""
    if max_rows is None:
        return df.withColumn(SLICE, F.lit(0).cast("long")), None
    keys = list(order.keys)
    instant = F.unix_micros(order.time)
    big = cut_lineage(
        df.groupBy(*keys)
        .agg(F.count("*").alias("_n"), F.min(instant).alias("_lo"), F.max(instant).alias("_hi"))
        .filter(F.col("_n") > max_rows)
        .select(*keys, "_lo", _cut(F.col("_lo"), F.col("_hi"), F.col("_n"), max_rows).alias("_width"))
    )
    if big.isEmpty():
        return df.withColumn(SLICE, F.lit(0).cast("long")), None
    cut_keys = big.select(*keys)
    part = F.coalesce(F.floor((instant - F.col("_lo")) / F.col("_width")), F.lit(0)).cast("long")
    sliced = _join_small(df, big, keys, "left").withColumn(SLICE, part).drop("_lo", "_width")
    while True:
        in_big = _join_small(sliced, cut_keys, keys, "left_semi")
        crowded = cut_lineage(_crowded(in_big, order, max_rows))
        if crowded.isEmpty():
            return sliced, cut_keys
        place = F.when(F.col("_by_time"), instant).otherwise(F.col(order.seq))
        beside = F.when(~F.col("_by_time") | (instant < F.col("_median")), 0).when(instant == F.col("_median"), 1).otherwise(2)
        part = F.floor((place - F.col("_lo")) / F.col("_width")) * 3 + beside
        sliced = (
            _join_small(sliced, crowded, order.by_slice, "left")
            .withColumn(SLICE, F.struct(F.col(SLICE), F.coalesce(part, F.lit(-1)).cast("long").alias("part")))
            .drop("_by_time", "_median", "_lo", "_width")
        )


def slice_series(df: DataFrame, order: Order = Order(), max_rows: int | None = MAX_ROWS) -> DataFrame:
    """Add ``_slice``, ascending with the order of rows within a key.

    A key of up to ``max_rows`` rows is one slice. A bigger one is cut by time,
    and slices that are still too big because their rows crowd together are cut
    again until none is. Big keys and crowded slices are looked for right away,
    reading keys and order columns only. Their tables have at most (all rows /
    max_rows) rows, so they are broadcast. Nothing is looked for or cut where
    ``max_rows`` is None, for sources known to have no big key.
    """
    return _slice(df, order, max_rows)[0]


def slice_sizes(sliced: DataFrame, order: Order = Order()) -> DataFrame:
    """Rows per slice (``_rows``) and rows of the key before it (``_before``)."""
    earlier = (
        Window.partitionBy(*order.keys).orderBy(SLICE)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        sliced.groupBy(*order.by_slice).agg(F.count("*").alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    )


def with_position(df: DataFrame, order: Order = Order(), max_rows: int | None = MAX_ROWS) -> DataFrame:
    """Add ``position`` (1-based place in the key's order) and ``series_rows``."""
    sliced = slice_series(df, order, max_rows)
    sizes = slice_sizes(sliced, order)
    whole = Window.partitionBy(*order.keys)
    sizes = sizes.withColumn("series_rows", F.sum("_rows").over(whole)).drop("_rows")
    in_slice = Window.partitionBy(*order.by_slice).orderBy(*order.columns)
    return (
        join_null_safe(sliced.withColumn("_place", F.row_number().over(in_slice)), sizes, order.by_slice, "inner")
        .withColumn("position", F.col("_before") + F.col("_place"))
        .drop("_place", "_before", SLICE)
    )


def last_rows(df: DataFrame, rows: int, order: Order, keys: Sequence[str], join: Callable[..., DataFrame] = join_null_safe) -> DataFrame:
    """The last rows of each of ``keys``, with their place from its end (``_from_end``).

    Only keys and order columns are sorted to find where the last rows begin; whole rows are sorted from there on.
    """
    backward = Window.partitionBy(*keys).orderBy(*order.latest_first())
    place = F.struct(*order.columns)
    # a rank bounded from above is applied in each task before the shuffle
    begins = cut_lineage(
        df.select(*keys, *order.columns).withColumn("_from_end", F.row_number().over(backward))
        .filter(F.col("_from_end") <= rows).groupBy(*keys).agg(F.min(place).alias("_begin"))
    )
    return (
        join(df, begins, keys, "inner").filter(place >= F.col("_begin")).drop("_begin")
        .withColumn("_from_end", F.row_number().over(backward)).filter(F.col("_from_end") <= rows)
    )


def _last_rows(sliced: DataFrame, rows: int, order: Order) -> DataFrame:
    """The last rows of each slice."""
    return last_rows(sliced, rows, order, order.by_slice, _join_small)


def with_run_up(df: DataFrame, rows_back: int, order: Order = Order(),
                max_rows: int | None = MAX_ROWS) -> DataFrame:
    """Sliced rows, plus for each slice copies of the ``rows_back`` rows before it.

    Copies have ``_copy`` true. Only keys cut into more than one slice get any.
    A slice can hold fewer than ``rows_back`` rows; its rows then go to every
    later slice they are near enough to.
    """
    sliced, cut_keys = _slice(df, order, max_rows)
    own = sliced.withColumn("_copy", F.lit(False))
    if cut_keys is None:
        return own
    following = Window.partitionBy(*order.keys).orderBy(SLICE).rowsBetween(1, rows_back)
    later = F.collect_list(F.struct(F.col(SLICE).alias("to"), F.col("_before").alias("start")))
    end = F.col("_before") + F.col("_rows")
    targets = cut_lineage(
        slice_sizes(_join_small(sliced, cut_keys, order.keys, "left_semi"), order)
        .withColumn("_later", later.over(following))
        .select(*order.by_slice, F.explode("_later").alias("_next"), end.alias("_end"))
        .select(*order.by_slice, F.col("_next.to").alias("_to"),
                (F.col("_next.start") - F.col("_end")).alias("_gap"))
        .filter(F.col("_gap") < rows_back)
    )
    ends = _last_rows(_join_small(sliced, cut_keys, order.keys, "left_semi"), rows_back, order)
    copies = (
        join_null_safe(ends, targets, order.by_slice, "inner")
        .filter(F.col("_gap") + F.col("_from_end") <= rows_back)
        .withColumn(SLICE, F.col("_to"))
        .withColumn("_copy", F.lit(True))
        .select(*sliced.columns, "_copy")
    )
    return own.unionByName(copies)


Kernel = Callable[[pd.DataFrame, np.ndarray], dict[str, np.ndarray]]


def stream_series(df: DataFrame, kernel: Kernel, inputs: Sequence[str], outputs: Sequence[str],
                  rows_back: int, order: Order = Order(), max_rows: int | None = MAX_ROWS,
                  keep: Sequence[str] | None = None) -> DataFrame:
    """Add double columns computed from a row and up to ``rows_back`` rows before it.

    Spark partitions and sorts the rows once; ``kernel`` then gets them in
    series order, batch by batch, with the number of each row's series. A task
    holds one Arrow batch and ``rows_back`` rows, however long a series is.
    Columns the kernel does not read pass by as Arrow arrays. With ``keep`` the result
    has no other columns, and rows are sorted and moved without what neither it nor the kernel reads.
    """
    inputs, outputs = list(inputs), list(outputs)
    passed = [c for c in df.columns if keep is None or c in keep]
    added_names = [c for c in outputs if keep is None or c in keep]
    moved = [c for c in df.columns if c in {*passed, *inputs, *order.keys, *order.columns}]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            here = pd.DataFrame({
                c: batch.column(c).to_numpy(zero_copy_only=False) for c in ["_group", *inputs]
            })
            rows = here if kept is None else pd.concat([kept, here], ignore_index=True)
            added = kernel(rows[inputs], rows["_group"].to_numpy())
            skip = len(rows) - len(here)
            kept = rows.iloc[-rows_back:]
            arrays = [batch.column(c) for c in passed]
            arrays += [pa.array(added[c][skip:], pa.float64(), from_pandas=True) for c in added_names]
            full = pa.RecordBatch.from_arrays(arrays, names=[*passed, *added_names])
            copies = batch.column("_copy")
            yield full.filter(pc.invert(copies)) if copies.true_count else full

    in_order = (
        with_run_up(df.select(*moved), rows_back, order, max_rows)
        .withColumn("_group", F.xxhash64(*order.by_slice))
        .repartition(*order.by_slice)
        .sortWithinPartitions(*order.by_slice, *order.columns)
        .select(*moved, "_group", "_copy")
    )
    added = [T.StructField(c, T.DoubleType()) for c in added_names]
    return in_order.mapInArrow(stream, T.StructType([*[df.schema[c] for c in passed], *added]))
