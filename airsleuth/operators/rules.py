"""Physics rules: stateless predicates on the feature row."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airsleuth.schema import HIT_COLUMNS, ROW_KEYS, SEQ, require_columns

# --- fixed values: thresholds; valves and dampers are fractions of 1 -------------
TRACKING_LIMIT = 0.08
VALVE_CLOSED = 0.02
LEAKAGE_DELTA_C = 1.5
BIAS_DELTA_C = 1.2
BIAS_STEADY_STD = 0.8
POWER_SIGMAS = 3.0

SOURCE = "rules"
#: What the rules read of a feature row besides its identity.
READ = [
    "valve_tracking_err_15_mean", "damper_tracking_err_15_mean", "chwc_valve_pct", "temp_supply_celsius", "temp_mixed_celsius",
    "sa_temp_error_c_60_mean", "sa_temp_error_c_60_std", "sf_power_w", "sf_power_w_60_mean", "sf_power_w_60_std",
]


@dataclass(frozen=True)
class Rule:
    """A policy, its level and trigger, and the columns that test and rate it."""

    policy: str
    level: str
    signal: str
    fires: Column
    index: Column

    def hit(self, no: int) -> Column:
        """The rule's place and hit where it fires, else null."""
        return F.when(self.fires, F.struct(
            F.lit(no).alias("rule_no"),
            F.struct(
                F.lit(self.policy).alias("violated_policy"),
                F.lit(self.level).alias("alert_level"),
                self.index.alias("anomaly_index"),
                F.lit(self.signal).alias("trigger_signal"),
            ).alias("hit"),
        ))


def rules() -> list[Rule]:
    """The rules in the order in which they win."""
    valve = F.abs("valve_tracking_err_15_mean")
    damper = F.abs("damper_tracking_err_15_mean")
    supply, mixed = F.col("temp_supply_celsius"), F.col("temp_mixed_celsius")
    bias = F.abs("sa_temp_error_c_60_mean")
    power, mean, std = F.col("sf_power_w"), F.col("sf_power_w_60_mean"), F.col("sf_power_w_60_std")
    return [
        Rule("VALVE_STUCK", "CRITICAL", "chwc_valve_pct",
             valve > TRACKING_LIMIT, valve / TRACKING_LIMIT),
        Rule("DAMPER_STUCK", "CRITICAL", "oa_damper_pct",
             damper > TRACKING_LIMIT, damper / TRACKING_LIMIT),
        Rule("COIL_LEAKAGE", "WARNING", "temp_supply_celsius",
             (F.col("chwc_valve_pct") < VALVE_CLOSED) & (supply < mixed - LEAKAGE_DELTA_C),
             (mixed - supply) / LEAKAGE_DELTA_C),
        Rule("SA_SETPOINT_BIAS", "WARNING", "temp_supply_celsius",
             (bias > BIAS_DELTA_C) & (F.col("sa_temp_error_c_60_std") < BIAS_STEADY_STD),
             bias / BIAS_DELTA_C),
        Rule("FAN_POWER_ANOMALY", "INFO", "sf_power_w",
             (std > 0.0) & (power > mean + POWER_SIGMAS * std),
             (power - mean) / F.nullif(std, F.lit(0.0))),
    ]


def _identity(df: DataFrame) -> list[Column]:
    truth = F.col("fault_type") if "fault_type" in df.columns else F.lit(None).cast("string")
    return [*[F.col(c) for c in ROW_KEYS], F.col(SEQ), truth.alias("ground_truth")]


def rule_hits(df: DataFrame) -> DataFrame:
    """Every hit of every rule, one row each, with the rule's place in ``rule_no``."""
    require_columns(df, [*ROW_KEYS, SEQ])
    hits = F.array(*[rule.hit(no) for no, rule in enumerate(rules(), start=1)])
    return (
        df.select(*_identity(df), F.explode(F.array_compact(hits)).alias("_fired"))
        .select(*ROW_KEYS, SEQ, "ground_truth", "_fired.rule_no", "_fired.hit.*",
                F.lit(SOURCE).alias("detector_source"))
    )


def rule_events(df: DataFrame) -> DataFrame:
    """One event per row key, from the first rule that fires there.

    The rules are tested in one pass; only rows that hit are shuffled, and rows
    of one key are reduced to one before the shuffle.
    """
    require_columns(df, [*ROW_KEYS, SEQ])
    any_fires = reduce(Column.__or__, [rule.fires for rule in rules()])
    first_hit = F.coalesce(*[rule.hit(no) for no, rule in enumerate(rules(), start=1)])
    fired = df.filter(any_fires).select(*_identity(df), first_hit.alias("_fired"))
    first = F.min_by(
        F.struct("_fired.hit", "ground_truth"), F.struct("_fired.rule_no", SEQ)
    )
    return (
        fired.groupBy(*ROW_KEYS).agg(first.alias("_first"))
        .select(*ROW_KEYS, "_first.hit.*", F.lit(SOURCE).alias("detector_source"), "_first.ground_truth")
        .select(ROW_KEYS[0], *HIT_COLUMNS)
    )
