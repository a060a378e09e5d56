"""Fixed-length windows of rows, as sequence models read them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airsleuth.operators.ordered import MAX_ROWS, SLICE, Order, with_run_up
from airsleuth.operators.splits import with_lookup

SEQUENCE_ROWS = 30


def sequence_windows(df: DataFrame, columns: Sequence[str], rows: int = SEQUENCE_ROWS,
                     order: Order = Order(), pad_short: bool = False,
                     max_rows: int = MAX_ROWS) -> DataFrame:
    """Add ``window``: the last ``rows`` rows as an array of arrays, oldest first.

    Only rows that end a whole window are kept. With ``pad_short`` a series of
    fewer rows gives one window at its last row, filled up with its first row.
    Windows never leave their series. They hold each value ``rows`` times, so
    they are floats, and best consumed right away.
    """
    series = Window.partitionBy(*order.by_slice)
    frame = series.orderBy(*order.columns).rowsBetween(1 - rows, 0)
    vector = F.array(*[F.col(c).cast("float") for c in columns])
    framed = (
        with_run_up(df, rows - 1, order, max_rows)
        .withColumn("window", F.collect_list(vector).over(frame))
        .withColumn("_series", F.count("*").over(series))
    )
    whole = F.size("window") == rows
    if pad_short:
        # A slice of a longer series has its run-up, so only a short series counts below ``rows``.
        ends_short = (F.col("_series") < rows) & (F.size("window") == F.col("_series"))
        filler = F.array_repeat(F.element_at("window", 1), F.lit(rows) - F.size("window"))
        framed = framed.withColumn(
            "window", F.when(ends_short, F.concat(filler, "window")).otherwise(F.col("window"))
        )
    return framed.filter(whole & ~F.col("_copy")).drop("_copy", "_series", SLICE)


def pad_head(df: DataFrame, column: str, order: Order = Order(), last: str | None = None) -> DataFrame:
    """Rows before a series' first value take that value.

    A series without any takes the value of the column ``last`` at its last row, if one is named.
    """
    at = F.struct(*order.columns)
    value = F.min_by(column, F.when(F.col(column).isNotNull(), at))
    if last is not None:
        value = F.coalesce(value, F.max_by(last, at))
    firsts = df.groupBy(*order.keys).agg(value.alias("_first"))
    return (
        with_lookup(df, firsts, list(order.keys), "_first")
        .withColumn(column, F.coalesce(column, "_first")).drop("_first")
    )
