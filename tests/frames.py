"""Small frames for tests."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pandas as pd

from airsleuth.schema import FAULT_TYPES, FEATURES, RAW_COLUMNS, ZONE_COLUMNS

START = datetime(2018, 1, 1)


def raw_frame(rows: int = 200, scenario: str = "AHU_annual.csv", fault: str = "normal", seed: int = 42) -> pd.DataFrame:
    random = np.random.default_rng(seed)
    frame = pd.DataFrame({c: random.uniform(0, 100, rows) for c in RAW_COLUMNS if c != "Datetime"})
    for c in ZONE_COLUMNS:
        frame[c] = random.uniform(68, 78, rows)
    frame.insert(0, "Datetime", [START + timedelta(minutes=i) for i in range(rows)])
    return frame.assign(scenario_file=scenario, fault_type=fault, row_seq=range(rows))


STEADY = {
    **{c: 0.0 for c in FEATURES},
    "chwc_valve_pct": 0.5, "temp_supply_celsius": 13.0, "temp_mixed_celsius": 15.0,
    "sf_power_w": 1000.0, "sf_power_w_60_mean": 1000.0, "sf_power_w_60_std": 100.0, "sa_temp_error_c_60_std": 0.1,
}


def feature_row(minute: int = 0, zone: str = "zone_1", fault: str = "normal", **values: float) -> dict:
    return {
        "scenario_file": "AHU_annual.csv", "event_time": START + timedelta(minutes=minute), "zone_id": zone,
        "fault_type": fault, "row_seq": minute, **STEADY, **values,
    }


SHIFTS = {
    "coi_bias": {"sa_temp_error_c": 3.0, "sa_temp_error_c_60_mean": 3.0},
    "coi_leakage": {"ra_sa_delta_c": 5.0, "ra_sa_delta_c_60_mean": 5.0},
    "coi_stuck": {"valve_tracking_err": 2.0, "valve_tracking_err_15_mean": 2.0},
    "damper_stuck": {"damper_tracking_err": 2.0, "damper_tracking_err_15_mean": 2.0},
    "oa_bias": {"ma_oa_delta_c": -4.0, "ma_oa_delta_c_60_mean": -4.0},
    "normal": {},
}


def separable_frame(per_class: int = 100, seed: int = 0) -> pd.DataFrame:
    """Six classes that differ by clear shifts, in series of their own."""
    random = np.random.default_rng(seed)
    parts = []
    for fault in FAULT_TYPES:
        part = pd.DataFrame([feature_row(i, fault=fault) for i in range(per_class)])
        part["scenario_file"] = f"{fault}.csv"
        part[FEATURES] = random.normal(0, 0.05, (per_class, len(FEATURES)))
        for column, shift in SHIFTS[fault].items():
            part[column] += shift
        parts.append(part)
    return pd.concat(parts, ignore_index=True)
