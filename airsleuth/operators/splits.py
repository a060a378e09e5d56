"""Temporal splits, scenario hold-out and reproducible samples."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airsleuth.functions.columns import complete, draw
from airsleuth.operators.ordered import MAX_ROWS, Order, with_position
from airsleuth.schema import FEATURES, NORMAL, SCENARIO, TIME, require_columns

# --- fixed values: bounds of the splits within a scenario's first year -----------
# (start of train, end of train, end of validation, end of final)
PROTOCOLS = {
    "annual": ("01-01 00:00:00", "09-30 23:59:59", "11-30 23:59:59", "12-31 23:59:59"),
    "common": ("04-01 00:00:00", "08-31 23:59:59", "09-30 23:59:59", "10-31 23:59:59"),
}
NORMAL_REFERENCE = "ahu_annual"
_BUCKET_DIGITS = 4  # 16 ** 4 buckets of a draw


#: Keys up to which a small table becomes a constant of the plan.
MOST_CONSTANTS = 1_000


def with_lookup(df: DataFrame, small: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """``df`` with ``column`` of a table that has one row per key; null where it has none.

    Keys are scenario files or their zones: few, with many rows each. A shuffle by
    them would put a whole scenario into one task, so the values become a constant map.
    Beyond ``MOST_CONSTANTS`` keys none of them holds many of all rows, and a join deals them out.
    """
    found = small.select(*keys, column).limit(MOST_CONSTANTS + 1).collect()
    if len(found) > MOST_CONSTANTS:
        return df.join(small.select(*keys, column), list(keys), "left")
    kind = small.schema[column].dataType
    if not found:
        return df.withColumn(column, F.lit(None).cast(kind))
    parts = {k: small.schema[k].dataType for k in keys}

    def constant(row) -> Column:
        return F.struct(*[F.lit(row[k]).cast(t).alias(k) for k, t in parts.items()])

    # A map has no null keys; structs of null fields are keys like others.
    pairs = [x for row in found for x in (constant(row), F.lit(row[column]).cast(kind))]
    return df.withColumn(column, F.element_at(F.create_map(*pairs), F.struct(*[F.col(k).alias(k) for k in keys])))


def first_years(df: DataFrame) -> DataFrame:
    """First year of each scenario, as ``base_year``."""
    return df.groupBy(SCENARIO).agg(F.min(F.year(TIME)).alias("base_year"))


def split_of(time: Column, base_year: Column, protocol: str) -> Column:
    """'train', 'validation' or 'final'; null outside all three."""
    if protocol not in PROTOCOLS:
        raise ValueError(f"unknown split protocol: {protocol!r}")
    # All bounds lie in the base year, so each row's own year tells them once it is known to be that one. The base
    # year, a lookup, is then read once, and no timestamp is parsed from text for each row.
    start, train, validation, final = [
        F.make_timestamp(F.year(time), *[F.lit(int(part)) for part in re.split("[- :]", bound)])
        for bound in PROTOCOLS[protocol]
    ]
    in_year = (
        F.when(time < start, F.lit(None))
        .when(time <= train, F.lit("train"))
        .when(time <= validation, F.lit("validation"))
        .when(time <= final, F.lit("final"))
    )
    return F.when(F.year(time) == base_year, in_year)


def temporal_split(df: DataFrame, protocol: str = "annual") -> DataFrame:
    """Add ``split``, each scenario by the calendar of its own first year."""
    require_columns(df, [SCENARIO, TIME])
    return with_lookup(df, first_years(df), [SCENARIO], "base_year").withColumn(
        "split", split_of(F.col(TIME), F.col("base_year"), protocol)
    ).drop("base_year")


def normal_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col("fault_type") == NORMAL)


def complete_rows(df: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """Rows with a whole feature vector and no null in the ``also`` columns."""
    test = complete(FEATURES)
    for name in also:
        test = test & F.col(name).isNotNull()
    return df.filter(test)


def without_scenario(df: DataFrame, held_out: str | None) -> DataFrame:
    """Training side of a hold-out."""
    return df if held_out is None else df.filter(F.col(SCENARIO) != held_out)


def only_scenario(df: DataFrame, held_out: str | None, with_normal_reference: bool = False) -> DataFrame:
    """Evaluation side of a hold-out: its rows, and those of the normal reference if asked."""
    if held_out is None:
        return df
    keep = F.col(SCENARIO) == held_out
    return df.filter(keep | is_normal_reference() if with_normal_reference else keep)


def is_normal_reference() -> Column:
    """Whether a row is of the scenario without faults that hold-outs are compared with."""
    return F.regexp_replace(F.lower(SCENARIO), r"\.[^.]*$", "") == NORMAL_REFERENCE


def sample_rows(df: DataFrame, wanted: Callable[[Column], Column], ids: Sequence[str],
                seed: int | Column, by: Sequence[str] = ()) -> DataFrame:
    """An exact number of rows per group, those with the lowest draws.

    ``wanted`` maps the group's row count to the rows to keep; ``ids`` must tell
    rows apart. Draws are counted in 65,536 buckets, so only the rows of the
    one bucket at the boundary are ranked, never a whole group.
    """
    by = list(by)
    drawn = df.withColumn("_draw", draw(ids, seed)).withColumn(
        "_bucket", F.substring("_draw", 1, _BUCKET_DIGITS)
    )
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    quota = (
        drawn.groupBy(*by, "_bucket").agg(F.count("*").alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .withColumn("_take", wanted(F.sum("_rows").over(group)).cast("long") - F.col("_before"))
        .filter(F.col("_take") > 0)
        .select(*by, "_bucket", "_take", (F.col("_rows") <= F.col("_take")).alias("_all"))
    )
    near = drawn.join(quota, [*by, "_bucket"])
    rank = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy("_draw", *ids))
    edge = (
        near.filter(~F.col("_all")).withColumn("_rank", rank)
        .filter(F.col("_rank") <= F.col("_take"))
    )
    return near.filter("_all").select(*df.columns).unionByName(edge.select(*df.columns))


def sample_for_mixture(df: DataFrame, ids: Sequence[str], seed: int = 42,
                       above: int = 100_000, share: float = 0.2) -> DataFrame:
    """A fifth of the rows when there are more than ``above``, else all."""
    return sample_rows(
        df, lambda n: F.when(n > above, F.floor(n * F.lit(share))).otherwise(n), ids, seed
    )


def sample_at_most(df: DataFrame, rows: int, ids: Sequence[str], seed: int = 42) -> DataFrame:
    return sample_rows(df, lambda n: F.least(n, F.lit(rows)), ids, seed)


def scenario_numbers(df: DataFrame) -> DataFrame:
    """Place of each scenario in name order, from 0, as ``scenario_no``."""
    place = F.row_number().over(Window.orderBy(SCENARIO)) - 1
    return df.select(SCENARIO).distinct().withColumn("scenario_no", place)


def sample_per_scenario(df: DataFrame, ids: Sequence[str], seed: int = 42,
                        share: float = 0.2) -> DataFrame:
    """A share of each scenario's rows, drawn with a seed of the scenario's own."""
    numbered = with_lookup(df, scenario_numbers(df), [SCENARIO], "scenario_no")
    drawn = sample_rows(
        numbered, lambda n: F.rint(n * F.lit(share)), ids,
        F.lit(seed) + F.col("scenario_no"), by=[SCENARIO],
    )
    return drawn.drop("scenario_no")


def contiguous_tail(df: DataFrame, share: float = 0.2, order: Order = Order(),
                    max_rows: int = MAX_ROWS) -> DataFrame:
    """The last ``share`` of every series, in one piece."""
    start = F.floor(F.col("series_rows") * F.lit(1 - share))
    return (
        with_position(df, order, max_rows)
        .filter(F.col("position") > start)
        .drop("position", "series_rows")
    )
