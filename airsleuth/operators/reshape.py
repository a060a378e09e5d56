"""Wide raw telemetry to long normalized telemetry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airsleuth.functions.columns import celsius, to_double
from airsleuth.schema import (
    COLUMN_MAP, FAHRENHEIT_COLUMNS, ZONE, ZONE_COLUMNS, require_columns,
)


def zones_to_rows(df: DataFrame) -> DataFrame:
    """One row per zone: ZONE_TEMP_1..5 become ``zone_id`` and ``ZONE_TEMP``."""
    require_columns(df, ZONE_COLUMNS)
    ids = [c for c in df.columns if c not in ZONE_COLUMNS]
    long = df.unpivot(ids, ZONE_COLUMNS, ZONE, "ZONE_TEMP")
    return long.withColumn(ZONE, F.replace(ZONE, F.lit("ZONE_TEMP_"), F.lit("zone_")))


def fahrenheit_to_celsius(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    require_columns(df, columns)
    return df.withColumns({c: celsius(F.col(c)) for c in columns})


def normalize_names(df: DataFrame) -> DataFrame:
    """Raw names to model names; other columns keep theirs."""
    return df.withColumnsRenamed(COLUMN_MAP)


def numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as doubles; what is no number becomes null."""
    return df.withColumns({c: to_double(c) for c in columns})


def narrow_floats(df: DataFrame) -> DataFrame:
    """Doubles as floats, for the cache only: rules on floats shift at their thresholds."""
    return df.select(*[
        F.col(name).cast("float").alias(name) if kind == "double" else F.col(name)
        for name, kind in df.dtypes
    ])


def normalize(wide: DataFrame) -> DataFrame:
    """Raw wide rows to long, Celsius, renamed rows."""
    return normalize_names(fahrenheit_to_celsius(zones_to_rows(wide), FAHRENHEIT_COLUMNS))


def normalize_wide(wide: DataFrame) -> DataFrame:
    """As ``normalize``, but the five zone columns are still side by side.

    All signals but the zone temperature belong to the air handler, so what is
    computed from them is the same for its five zones. Features are built on
    this form and copied to the zones last, which saves four fifths of the work.
    """
    temperatures = [c for c in FAHRENHEIT_COLUMNS if c != "ZONE_TEMP"] + ZONE_COLUMNS
    return normalize_names(fahrenheit_to_celsius(wide, temperatures))


def copy_to_zones(wide: DataFrame) -> DataFrame:
    """Rows of ``normalize_wide`` (with or without features) to one row per zone."""
    return normalize_names(zones_to_rows(wide))
