"""Names and types of the data model.

The values here are fixed: files, caches and stored events written by other
tools carry exactly these names, so results only match when they are kept.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from airsleuth.errors import SchemaValidationError

# --- fixed values: raw telemetry ------------------------------------------------

RAW_TIME = "Datetime"

RAW_SIGNALS = [
    "CHWC_VLV", "CHWC_VLV_DM",
    "MA_TEMP",
    "OA_CFM", "OA_DMPR", "OA_DMPR_DM", "OA_TEMP",
    "RA_CFM", "RA_DMPR", "RA_DMPR_DM", "RA_TEMP",
    "RF_CS", "RF_SPD", "RF_SPD_DM", "RF_WAT",
    "SA_CFM", "SA_SP", "SA_SPSPT", "SA_TEMP", "SA_TEMPSPT",
    "SF_CS", "SF_SPD", "SF_SPD_DM", "SF_WAT",
    "SYS_CTL",
]
ZONE_COLUMNS = [f"ZONE_TEMP_{k}" for k in range(1, 6)]
RAW_COLUMNS = [RAW_TIME, *RAW_SIGNALS, *ZONE_COLUMNS]

FAHRENHEIT_COLUMNS = ["SA_TEMP", "SA_TEMPSPT", "RA_TEMP", "MA_TEMP", "OA_TEMP", "ZONE_TEMP"]

COLUMN_MAP = {
    "Datetime": "event_time",
    "SA_TEMP": "temp_supply_celsius",
    "SA_TEMPSPT": "temp_supply_setpoint_c",
    "RA_TEMP": "temp_return_celsius",
    "MA_TEMP": "temp_mixed_celsius",
    "OA_TEMP": "temp_outside_celsius",
    "ZONE_TEMP": "temp_zone_c",
    "CHWC_VLV": "chwc_valve_pct",
    "CHWC_VLV_DM": "chwc_valve_demand_pct",
    "OA_DMPR": "oa_damper_pct",
    "OA_DMPR_DM": "oa_damper_demand_pct",
    "RA_DMPR": "ra_damper_pct",
    "RA_DMPR_DM": "ra_damper_demand_pct",
    "SF_SPD": "sf_speed_pct",
    "SF_SPD_DM": "sf_speed_demand_pct",
    "SF_WAT": "sf_power_w",
    "SF_CS": "sf_fan_status",
    "RF_SPD": "rf_speed_pct",
    "RF_SPD_DM": "rf_speed_demand_pct",
    "RF_WAT": "rf_power_w",
    "RF_CS": "rf_fan_status",
    "SA_CFM": "supply_air_cfm",
    "OA_CFM": "outside_air_cfm",
    "RA_CFM": "return_air_cfm",
    "SA_SP": "supply_air_static_pressure_pa",
    "SA_SPSPT": "supply_air_static_pressure_setpoint_pa",
    "SYS_CTL": "sys_control_mode",
}

# --- fixed values: labels -------------------------------------------------------

NORMAL = "normal"
FAULT_TYPES = ["normal", "coi_bias", "coi_leakage", "coi_stuck", "damper_stuck", "oa_bias"]

# Part of a file name that tells its label; the first match counts.
FILE_KEYS = {
    "ahu_annual": "normal",
    "coi_bias": "coi_bias",
    "coi_leakage": "coi_leakage",
    "coi_stuck": "coi_stuck",
    "damper_stuck": "damper_stuck",
    "oa_bias": "oa_bias",
}

# From mild to severe.
ALERT_LEVELS = ["INFO", "WARNING", "CRITICAL"]

# --- fixed values: features -----------------------------------------------------

# error or delta = first column - second column
DIFFERENCES = {
    "valve_tracking_err": ("chwc_valve_pct", "chwc_valve_demand_pct"),
    "damper_tracking_err": ("oa_damper_pct", "oa_damper_demand_pct"),
    "sf_tracking_err": ("sf_speed_pct", "sf_speed_demand_pct"),
    "sa_temp_error_c": ("temp_supply_celsius", "temp_supply_setpoint_c"),
    "ma_oa_delta_c": ("temp_mixed_celsius", "temp_outside_celsius"),
    "ra_sa_delta_c": ("temp_return_celsius", "temp_supply_celsius"),
    "sa_oa_temp_diff_c": ("temp_supply_celsius", "temp_outside_celsius"),
}

ROLLING_WINDOWS = [15, 60, 120]
ROLLING_COLUMNS = [
    "sa_temp_error_c", "valve_tracking_err", "damper_tracking_err",
    "ma_oa_delta_c", "ra_sa_delta_c", "chwc_valve_pct", "oa_damper_pct",
]
POWER_COLUMN = "sf_power_w"
POWER_WINDOW = 60
LAG_COLUMNS = ["sa_oa_temp_diff_c", "chwc_valve_pct", "oa_damper_pct"]

# The ordered input vector of every learned detector.
FEATURES = [
    "valve_tracking_err", "damper_tracking_err", "sf_tracking_err",
    "sa_temp_error_c", "ma_oa_delta_c", "ra_sa_delta_c",
    "valve_tracking_err_15_mean", "valve_tracking_err_60_mean", "valve_tracking_err_120_mean",
    "damper_tracking_err_15_mean", "damper_tracking_err_60_mean", "damper_tracking_err_120_mean",
    "sa_temp_error_c_15_mean", "sa_temp_error_c_60_mean", "sa_temp_error_c_120_mean",
    "ma_oa_delta_c_15_mean", "ma_oa_delta_c_60_mean", "ma_oa_delta_c_120_mean",
    "ra_sa_delta_c_15_mean", "ra_sa_delta_c_60_mean", "ra_sa_delta_c_120_mean",
    "chwc_valve_pct_15_mean", "chwc_valve_pct_60_mean", "chwc_valve_pct_120_mean",
    "oa_damper_pct_15_mean", "oa_damper_pct_60_mean", "oa_damper_pct_120_mean",
    "sf_power_w_60_mean",
    "sa_oa_temp_diff_c_lag1", "chwc_valve_pct_lag1", "oa_damper_pct_lag1",
]

# What the physics rules read besides FEATURES.
RULE_INPUTS = [
    "chwc_valve_pct", "temp_supply_celsius", "temp_mixed_celsius",
    "sf_power_w", "sa_temp_error_c_60_std", "sf_power_w_60_std",
]

# Default projection of a cache read: 3 ids, 6 rule inputs, 31 features.
CACHE_COLUMNS = ["event_time", "zone_id", "fault_type", *RULE_INPUTS, *FEATURES]

# --- row contracts --------------------------------------------------------------

SCENARIO = "scenario_file"
TIME = "event_time"
ZONE = "zone_id"
SEQ = "row_seq"
# One row of telemetry; a pair (zone, minute) repeats in every scenario file.
ROW_KEYS = [SCENARIO, TIME, ZONE]
# What a run from the cache reads: the default projection, and what tells rows apart.
RUN_COLUMNS = [SCENARIO, SEQ, *CACHE_COLUMNS]
SERIES_KEYS = [SCENARIO, ZONE]

HIT_COLUMNS = [
    "event_time", "zone_id", "violated_policy", "alert_level",
    "anomaly_index", "trigger_signal", "detector_source", "ground_truth",
]
CLASSIFIED_COLUMNS = [*HIT_COLUMNS, "predicted_fault", "confidence"]

EVENT_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("event_time", T.TimestampType()),
    T.StructField("zone_id", T.StringType()),
    T.StructField("equipment_id", T.StringType()),
    T.StructField("detector_source", T.StringType()),
    T.StructField("violated_policy", T.StringType()),
    T.StructField("trigger_signal", T.StringType()),
    T.StructField("anomaly_index", T.DoubleType()),
    T.StructField("alert_level", T.StringType()),
    T.StructField("ground_truth", T.StringType()),
    T.StructField("predicted_fault", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("created_at", T.TimestampType()),
])

JOB_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("scenario", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("error_msg", T.StringType()),
    T.StructField("started_at", T.TimestampType()),
    T.StructField("finished_at", T.TimestampType()),
    T.StructField("records_processed", T.LongType()),
    T.StructField("anomalies_found", T.LongType()),
])


def require_columns(df: DataFrame, columns: Iterable[str], error: type[Exception] = SchemaValidationError,
                    hint: str = "") -> DataFrame:
    """Return ``df`` if it has all ``columns``; runs no job."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise error(f"missing columns: {missing}{'; ' + hint if hint else ''}")
    return df
