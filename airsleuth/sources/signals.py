"""Telemetry derived from the generic ``events`` table.

Every event becomes one raw wide telemetry row of one scenario file. All
signals are multiples of a power of two computed from integers, so sums over
them are exact and two engines agree on them bit for bit. Faults are switched
on for long stretches of events, so sustained errors occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airsleuth.functions.columns import fault_of_file
from airsleuth.schema import RAW_COLUMNS, SCENARIO, SEQ

# --- fixed values: scenario file of each slot (user_id modulo 12) ----------------
SCENARIO_SLOTS = [
    "AHU_annual.csv", "AHU_annual.csv", "AHU_annual.csv",
    "coi_bias_-2_annual.csv", "coi_bias_4_annual.csv",
    "coi_leakage_010_annual.csv", "coi_leakage_050_annual.csv",
    "coi_stuck_025_annual.csv", "coi_stuck_075_annual.csv",
    "damper_stuck_010_annual.csv", "damper_stuck_100_annual_short.csv",
    "oa_bias_-4_annual.csv",
]
BASE_MICROS = 1_704_067_200_000_000  # 2024-01-01, the first day of the events table
STRETCH = 12  # 30 days of events cover a year, so that temporal splits find rows


def _noise(a: int, b: int) -> Column:
    """Uniform on a grid of 1/1024 in [0, 1)."""
    return (F.col("event_id") * a + b) % 1024 / F.lit(1024.0)


def wide_signals(events: DataFrame) -> DataFrame:
    """Raw wide rows: the 31 raw columns, scenario_file, fault_type and row_seq."""
    event = F.col("event_id")
    slot = F.col("user_id") % len(SCENARIO_SLOTS)
    scenario = F.element_at(F.lit(SCENARIO_SLOTS), (slot + 1).cast("int"))
    label = fault_of_file(scenario)
    active = F.floor(event / 3000) % 2 == 1

    def during(fault: str, then: Column | float, otherwise: Column | float = 0.0) -> Column:
        return F.when(active & (label == fault), then).otherwise(otherwise)

    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    valve_demand = 0.25 + 0.5 * _noise(37, 11)
    damper_demand = 0.125 + 0.5 * _noise(41, 5)
    damper = damper_demand + (_noise(59, 3) - 0.5) / 16 + during("damper_stuck", 0.125)
    supply_fan = 0.5 + 0.25 * _noise(43, 17)
    return_fan = 0.5 + 0.25 * _noise(47, 29)
    spike = F.when((F.col("event_type") == "purchase") & (event % 97 < 4), 4096.0).otherwise(0.0)
    values = {
        "Datetime": F.timestamp_micros(F.lit(BASE_MICROS) + (micros - BASE_MICROS) * STRETCH),
        "CHWC_VLV": F.when(
            event % 211 != 0,
            during("coi_leakage", _noise(61, 7) / 64, valve_demand + (_noise(53, 7) - 0.5) / 16)
            + during("coi_stuck", 0.125),
        ),
        "CHWC_VLV_DM": during("coi_leakage", _noise(67, 9) / 64, valve_demand),
        "MA_TEMP": during("coi_leakage", 62.0, 58 + 4 * _noise(71, 13)),
        "OA_CFM": 400 + 64 * _noise(73, 1),
        "OA_DMPR": damper,
        "OA_DMPR_DM": damper_demand,
        "OA_TEMP": 50 + 16 * _noise(79, 19) + during("oa_bias", -4.0),
        "RA_CFM": 1800 + 64 * _noise(83, 2),
        "RA_DMPR": 1 - damper,
        "RA_DMPR_DM": 1 - damper_demand,
        "RA_TEMP": 72 + 2 * _noise(89, 23),
        "RF_CS": F.lit(1.0),
        "RF_SPD": return_fan + (_noise(97, 31) - 0.5) / 32,
        "RF_SPD_DM": return_fan,
        "RF_WAT": 512 + 64 * _noise(101, 37),
        "SA_CFM": 2000 + 128 * _noise(103, 41),
        "SA_SP": 1.5 + _noise(107, 43) / 4,
        "SA_SPSPT": F.lit(1.625),
        "SA_TEMP": 54 + 2 * _noise(109, 47)
        + during("coi_bias", 4.0) + during("oa_bias", 3.0) + during("coi_leakage", -3.0),
        "SA_TEMPSPT": F.lit(55.0),
        "SF_CS": F.lit(1.0),
        "SF_SPD": supply_fan + (_noise(113, 53) - 0.5) / 32,
        "SF_SPD_DM": supply_fan,
        "SF_WAT": 1024 + 64 * _noise(127, 59) + F.floor(F.col("value") * 4) / F.lit(4.0) + spike,
        "SYS_CTL": (event % 4).cast("double"),
        **{f"ZONE_TEMP_{k}": 68 + k / 2 + 4 * _noise(131 + 2 * k, k) for k in range(1, 6)},
    }
    return events.select(
        scenario.alias(SCENARIO), label.alias("fault_type"), event.alias(SEQ),
        *[values[name].alias(name) for name in RAW_COLUMNS],
    )


def load_wide_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["event_id", "ts", "user_id", "event_type", "value"]
    return wide_signals(spark.read.parquet(f"{sf_dir}/events.parquet").select(*columns))
