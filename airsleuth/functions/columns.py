"""Column expressions; all of them stay inside generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from airsleuth.schema import ALERT_LEVELS, FAULT_TYPES, FILE_KEYS, NORMAL


def celsius(fahrenheit: Column) -> Column:
    """Fahrenheit to Celsius, evaluated left to right."""
    return (fahrenheit - F.lit(32)) * F.lit(5) / F.lit(9)


def to_double(name: str) -> Column:
    """Number or null: text that is no number and NaN both become null."""
    return F.nullif(F.expr(f"try_cast(`{name}` AS DOUBLE)"), F.lit(float("nan")))


def parse_time(text: Column) -> Column:
    """A timestamp in ISO form or in the month/day/year form of spreadsheet exports."""
    return F.coalesce(
        F.try_to_timestamp(text),
        F.try_to_timestamp(text, F.lit("M/d/yyyy H:mm")),
        F.try_to_timestamp(text, F.lit("M/d/yyyy H:mm:ss")),
    )


def fault_of_file(file_name: Column) -> Column:
    """Label told by a file name; null when no known part occurs in it."""
    lower = F.lower(file_name)
    label = F.lit(None).cast("string")
    for key, fault in reversed(FILE_KEYS.items()):
        label = F.when(lower.contains(key), F.lit(fault)).otherwise(label)
    return label


def key_of_fault(fault: Column) -> Column:
    """The file name part registered for a label; null when there is none."""
    pairs = [F.lit(v) for key, value in FILE_KEYS.items() for v in (value, key)]
    return F.create_map(*pairs)[fault]


def is_fault(label: Column) -> Column:
    return label != F.lit(NORMAL)


def alert_level(score: Column, warning: Column | float, critical: Column | float) -> Column:
    """CRITICAL from ``critical`` upward, WARNING from ``warning`` upward, else INFO."""
    return (
        F.when(score >= critical, F.lit("CRITICAL"))
        .when(score >= warning, F.lit("WARNING"))
        .otherwise(F.lit("INFO"))
    )


def severity(level: Column) -> Column:
    """Rank of an alert level, 0 for the mildest; null for an unknown level."""
    return F.nullif(F.array_position(F.lit(ALERT_LEVELS), level), F.lit(0)) - 1


def known_fault(label: Column) -> Column:
    """The label if it is a known fault type, else null."""
    return F.when(label.isin(FAULT_TYPES), label)


def known_level(level: Column) -> Column:
    """The level if it is known, else INFO."""
    return F.when(level.isin(ALERT_LEVELS), level).otherwise(F.lit("INFO"))


def fault_family(label: Column) -> Column:
    """Coarse family of a fault."""
    return (
        F.when(label.contains("bias"), F.lit("sensor_bias"))
        .when(label.contains("stuck"), F.lit("actuator_stuck"))
        .when(label.contains("leakage"), F.lit("actuator_leakage"))
        .otherwise(F.lit("unknown"))
    )


def or_unknown(label: Column) -> Column:
    """Null or empty becomes 'unknown'."""
    return F.coalesce(F.nullif(label, F.lit("")), F.lit("unknown"))


def complete(columns: Sequence[str]) -> Column:
    """True where none of ``columns`` is null or NaN."""
    test = F.lit(True)
    for name in columns:
        test = test & F.col(name).isNotNull() & ~F.isnan(name)
    return test


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, and 0 where whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def minutes_between(later: Column, earlier: Column) -> Column:
    """Difference in minutes with microsecond resolution."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(6e7)


def draw(columns: Sequence[str], seed: Column | int) -> Column:
    """A reproducible uniform draw per row, as hexadecimal text of fixed width.

    The draw depends on the row's values alone, so a task that is run again
    draws the same rows.
    """
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.md5(F.concat_ws("|", seed.cast("string"), *[F.col(c).cast("string") for c in columns]))
