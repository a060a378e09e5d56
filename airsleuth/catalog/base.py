"""Registry of queries with their SQL twins, and the SQL both kinds of tables start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airsleuth.functions.columns import fault_of_file
from airsleuth.operators.features import build_features_from_wide
from airsleuth.operators.reshape import normalize
from airsleuth.schema import DIFFERENCES, LAG_COLUMNS, ROLLING_COLUMNS, ROLLING_WINDOWS
from airsleuth.session import tune
from airsleuth.sources.signals import BASE_MICROS, SCENARIO_SLOTS, STRETCH, load_wide_signals

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and its SQL where the result can be expressed in SQL."""
    def register(run: Query) -> Query:
        def tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(tune(spark), sf_dir)

        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = tuned
        if sql is not None:
            ORACLES[name] = sql
        return run
    return register


# --- the same tables in Spark -----------------------------------------------------


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_wide_signals(spark, sf_dir)


def long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize(wide(spark, sf_dir))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_features_from_wide(wide(spark, sf_dir))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored events, one per row of the events table; for reads that need no detector."""
    e, user, value = F.col("event_id"), F.col("user_id"), F.col("value")
    label = fault_of_file(F.element_at(F.lit(SCENARIO_SLOTS), (user % 12 + 1).cast("int")))
    micros = F.lit(BASE_MICROS) + (F.unix_micros(F.col("ts").cast("timestamp")) - BASE_MICROS) * STRETCH
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        e.alias("id"), F.timestamp_micros(micros).alias("event_time"),
        F.concat(F.lit("zone_"), (user % 5 + 1).cast("string")).alias("zone_id"),
        F.concat(F.lit("AHU-"), (user % 3 + 1).cast("string")).alias("equipment_id"),
        F.when(F.col("event_type") == "click", "rules").when(F.col("event_type") == "view", "gmm_detector")
        .otherwise("classifier").alias("detector_source"),
        F.upper("event_type").alias("violated_policy"), F.lit("sf_power_w").alias("trigger_signal"),
        value.alias("anomaly_index"),
        F.when(value >= 40, "CRITICAL").when(value >= 20, "WARNING").otherwise("INFO").alias("alert_level"),
        F.when(e % 7 != 0, label).alias("ground_truth"),
        F.when(e % 5 == 0, F.lit(None)).when(e % 5 == 1, F.lit("")).otherwise(label).alias("predicted_fault"),
        F.when(e % 5 > 1, e % 1024 / F.lit(1024.0)).alias("confidence"),
        F.timestamp_micros(micros + 3_600_000_000).alias("created_at"),
    )


# Derived signals lie on a grid, so a mean can lie just halfway between two rounded
# values. A step off the grid keeps the last bit from deciding which one is taken.
OFF_GRID = 1.2345e-7


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) + OFF_GRID, digits) for c in columns})


def micros(column: str) -> Column:
    return F.unix_micros(column)


# --- the same tables in SQL -------------------------------------------------------


def _noise(a: int, b: int) -> str:
    return f"(((e * {a} + {b}) % 1024) / 1024e0)"


def _label(name: str) -> str:
    """Label of a file name in SQL."""
    keys = ["ahu_annual", "coi_bias", "coi_leakage", "coi_stuck", "damper_stuck", "oa_bias"]
    whens = " ".join(
        f"WHEN contains(lower({name}), '{k}') THEN '{'normal' if k == 'ahu_annual' else k}'" for k in keys
    )
    return f"CASE {whens} END"


def _during(fault: str, then: str, otherwise: str = "0e0") -> str:
    return f"(CASE WHEN active AND fault_type = '{fault}' THEN {then} ELSE {otherwise} END)"


_SLOTS = "[" + ", ".join(f"'{s}'" for s in SCENARIO_SLOTS) + "]"
EVENT_US = f"({BASE_MICROS} + (epoch_us(ts) - {BASE_MICROS}) * {STRETCH})"

_VALVE_DEMAND = f"(0.25e0 + 0.5e0 * {_noise(37, 11)})"
_DAMPER_DEMAND = f"(0.125e0 + 0.5e0 * {_noise(41, 5)})"
_DAMPER = f"({_DAMPER_DEMAND} + ({_noise(59, 3)} - 0.5e0) / 16 + {_during('damper_stuck', '0.125e0')})"
_SUPPLY_FAN = f"(0.5e0 + 0.25e0 * {_noise(43, 17)})"
_RETURN_FAN = f"(0.5e0 + 0.25e0 * {_noise(47, 29)})"
_VALVE = _during("coi_leakage", f"{_noise(61, 7)} / 64", f"{_VALVE_DEMAND} + ({_noise(53, 7)} - 0.5e0) / 16")

WIDE = f"""
base AS (
  SELECT event_id AS e, event_id AS row_seq, ts, event_type, value, (event_id // 3000) % 2 = 1 AS active,
         {_SLOTS}[CAST(user_id % 12 + 1 AS INTEGER)] AS scenario_file
  FROM events),
labelled AS (SELECT *, {_label('scenario_file')} AS fault_type FROM base),
wide AS (
  SELECT scenario_file, fault_type, row_seq, make_timestamp({EVENT_US}) AS "Datetime",
    CASE WHEN e % 211 <> 0 THEN {_VALVE} + {_during('coi_stuck', '0.125e0')} END AS CHWC_VLV,
    {_during('coi_leakage', f'{_noise(67, 9)} / 64', _VALVE_DEMAND)} AS CHWC_VLV_DM,
    {_during('coi_leakage', '62e0', f'58 + 4 * {_noise(71, 13)}')} AS MA_TEMP,
    400 + 64 * {_noise(73, 1)} AS OA_CFM, {_DAMPER} AS OA_DMPR, {_DAMPER_DEMAND} AS OA_DMPR_DM,
    50 + 16 * {_noise(79, 19)} + {_during('oa_bias', '-4e0')} AS OA_TEMP,
    1800 + 64 * {_noise(83, 2)} AS RA_CFM, 1 - {_DAMPER} AS RA_DMPR, 1 - {_DAMPER_DEMAND} AS RA_DMPR_DM,
    72 + 2 * {_noise(89, 23)} AS RA_TEMP, 1e0 AS RF_CS,
    {_RETURN_FAN} + ({_noise(97, 31)} - 0.5e0) / 32 AS RF_SPD, {_RETURN_FAN} AS RF_SPD_DM,
    512 + 64 * {_noise(101, 37)} AS RF_WAT, 2000 + 128 * {_noise(103, 41)} AS SA_CFM,
    1.5e0 + {_noise(107, 43)} / 4 AS SA_SP, 1.625e0 AS SA_SPSPT,
    54 + 2 * {_noise(109, 47)} + {_during('coi_bias', '4e0')} + {_during('oa_bias', '3e0')}
      + {_during('coi_leakage', '-3e0')} AS SA_TEMP,
    55e0 AS SA_TEMPSPT, 1e0 AS SF_CS,
    {_SUPPLY_FAN} + ({_noise(113, 53)} - 0.5e0) / 32 AS SF_SPD, {_SUPPLY_FAN} AS SF_SPD_DM,
    1024 + 64 * {_noise(127, 59)} + floor(value * 4) / 4e0
      + CASE WHEN event_type = 'purchase' AND e % 97 < 4 THEN 4096e0 ELSE 0e0 END AS SF_WAT,
    CAST(e % 4 AS DOUBLE) AS SYS_CTL,
    {', '.join(f'{68 + k / 2}e0 + 4 * {_noise(131 + 2 * k, k)} AS ZONE_TEMP_{k}' for k in range(1, 6))}
  FROM labelled)"""

_SIGNALS = """
    (SA_TEMP - 32) * 5 / 9 AS temp_supply_celsius, (SA_TEMPSPT - 32) * 5 / 9 AS temp_supply_setpoint_c,
    (RA_TEMP - 32) * 5 / 9 AS temp_return_celsius, (MA_TEMP - 32) * 5 / 9 AS temp_mixed_celsius,
    (OA_TEMP - 32) * 5 / 9 AS temp_outside_celsius,
    CHWC_VLV AS chwc_valve_pct, CHWC_VLV_DM AS chwc_valve_demand_pct,
    OA_DMPR AS oa_damper_pct, OA_DMPR_DM AS oa_damper_demand_pct,
    RA_DMPR AS ra_damper_pct, RA_DMPR_DM AS ra_damper_demand_pct,
    SF_SPD AS sf_speed_pct, SF_SPD_DM AS sf_speed_demand_pct, SF_WAT AS sf_power_w, SF_CS AS sf_fan_status,
    RF_SPD AS rf_speed_pct, RF_SPD_DM AS rf_speed_demand_pct, RF_WAT AS rf_power_w, RF_CS AS rf_fan_status,
    SA_CFM AS supply_air_cfm, OA_CFM AS outside_air_cfm, RA_CFM AS return_air_cfm,
    SA_SP AS supply_air_static_pressure_pa, SA_SPSPT AS supply_air_static_pressure_setpoint_pa,
    SYS_CTL AS sys_control_mode"""

LONG = WIDE + ",\nlong AS (" + "\n  UNION ALL".join(
    f"""
  SELECT scenario_file, fault_type, row_seq, "Datetime" AS event_time, 'zone_{k}' AS zone_id,
    (ZONE_TEMP_{k} - 32) * 5 / 9 AS temp_zone_c,{_SIGNALS}
  FROM wide""" for k in range(1, 6)
) + ")"

ERRORS = LONG + f""",
errors AS (
  SELECT *, {', '.join(f'{a} - {b} AS {n}' for n, (a, b) in DIFFERENCES.items())}
  FROM long)"""

SERIES = "PARTITION BY scenario_file, zone_id ORDER BY event_time, row_seq"


def frame(n: int) -> str:
    return f"OVER ({SERIES} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _rolling(column: str, n: int) -> str:
    return (f"avg({column}) {frame(n)} AS {column}_{n}_mean, "
            f"coalesce(stddev_samp({column}) {frame(n)}, 0) AS {column}_{n}_std")


FEATURE_ROWS = ERRORS + f""",
features AS (
  SELECT *,
    {', '.join(_rolling(c, n) for c in ROLLING_COLUMNS for n in ROLLING_WINDOWS)},
    {_rolling('sf_power_w', 60)},
    {', '.join(f'lag({c}) OVER ({SERIES}) AS {c}_lag1' for c in LAG_COLUMNS)}
  FROM errors)"""

DETECTIONS = f"""
detections AS (
  SELECT event_id AS id, make_timestamp({EVENT_US}) AS event_time,
    'zone_' || (user_id % 5 + 1) AS zone_id, 'AHU-' || (user_id % 3 + 1) AS equipment_id,
    CASE event_type WHEN 'click' THEN 'rules' WHEN 'view' THEN 'gmm_detector' ELSE 'classifier' END AS detector_source,
    upper(event_type) AS violated_policy, 'sf_power_w' AS trigger_signal, value AS anomaly_index,
    CASE WHEN value >= 40 THEN 'CRITICAL' WHEN value >= 20 THEN 'WARNING' ELSE 'INFO' END AS alert_level,
    CASE WHEN event_id % 7 <> 0 THEN label END AS ground_truth,
    CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN '' ELSE label END AS predicted_fault,
    CASE WHEN event_id % 5 > 1 THEN (event_id % 1024) / 1024e0 END AS confidence,
    make_timestamp({EVENT_US} + 3600000000) AS created_at
  FROM (SELECT *, {_label(f'{_SLOTS}[CAST(user_id % 12 + 1 AS INTEGER)]')} AS label FROM events))"""


def _hit(policy: str, level: str, signal: str, fires: str, index: str) -> dict[str, str]:
    return {"policy": policy, "level": level, "signal": signal, "fires": fires, "index": index}


RULES = [
    _hit("VALVE_STUCK", "CRITICAL", "chwc_valve_pct",
         "abs(valve_tracking_err_15_mean) > 0.08e0", "abs(valve_tracking_err_15_mean) / 0.08e0"),
    _hit("DAMPER_STUCK", "CRITICAL", "oa_damper_pct",
         "abs(damper_tracking_err_15_mean) > 0.08e0", "abs(damper_tracking_err_15_mean) / 0.08e0"),
    _hit("COIL_LEAKAGE", "WARNING", "temp_supply_celsius",
         "chwc_valve_pct < 0.02e0 AND temp_supply_celsius < temp_mixed_celsius - 1.5e0",
         "(temp_mixed_celsius - temp_supply_celsius) / 1.5e0"),
    _hit("SA_SETPOINT_BIAS", "WARNING", "temp_supply_celsius",
         "abs(sa_temp_error_c_60_mean) > 1.2e0 AND sa_temp_error_c_60_std < 0.8e0",
         "abs(sa_temp_error_c_60_mean) / 1.2e0"),
    _hit("FAN_POWER_ANOMALY", "INFO", "sf_power_w",
         "sf_power_w_60_std > 0 AND sf_power_w > sf_power_w_60_mean + 3e0 * sf_power_w_60_std",
         "(sf_power_w - sf_power_w_60_mean) / sf_power_w_60_std"),
]

HITS = FEATURE_ROWS + ",\nhits AS (" + "\n  UNION ALL".join(
    f"""
  SELECT scenario_file, event_time, zone_id, row_seq, fault_type AS ground_truth, {no} AS rule_no,
    '{r['policy']}' AS violated_policy, '{r['level']}' AS alert_level, {r['index']} AS anomaly_index,
    '{r['signal']}' AS trigger_signal, 'rules' AS detector_source
  FROM features WHERE {r['fires']}""" for no, r in enumerate(RULES, start=1)
) + """),
rule_events AS (
  SELECT * FROM hits
  QUALIFY row_number() OVER (PARTITION BY scenario_file, event_time, zone_id ORDER BY rule_no, row_seq) = 1)"""


def with_sql(tables: str, select: str) -> str:
    return f"WITH {tables}\n{select}"


def r6(expression: str, name: str | None = None, digits: int = 6) -> str:
    """Rounded expression in SQL; adding 0 turns a negative zero into zero."""
    return f"round({expression} + {OFF_GRID}, {digits}) + 0e0 AS {name or expression}"
