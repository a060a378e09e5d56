"""Slices of series, run-ups, positions, features and bursts against brute force."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from airsleuth.errors import FeatureEngineeringError, SchemaValidationError
from airsleuth.operators.evaluation import alert_bursts, gaps
from airsleuth.operators.features import (
    FRAMES, LAG_OUTPUTS, ROLLING_OUTPUTS, add_windows, build_features, build_features_from_wide, control_errors,
)
from airsleuth.operators.ordered import MAX_ROWS, SLICE, Order, _last_rows, slice_series, with_position, with_run_up
from airsleuth.operators.reshape import fahrenheit_to_celsius, narrow_floats, normalize, numbers, zones_to_rows
from airsleuth.operators.sequence import pad_head, sequence_windows
from airsleuth.schema import COLUMN_MAP, LAG_COLUMNS
from tests.frames import raw_frame

ORDER = Order(keys=("k",), time="t", seq="s")


def skewed(seed: int = 1) -> pd.DataFrame:
    """One key holds most rows; a third of all rows share one instant; another key has gaps."""
    random = np.random.default_rng(seed)
    base = datetime(2024, 1, 1)
    rows = [("hot", base + timedelta(seconds=int(x)), i) for i, x in enumerate(random.integers(0, 10**6, 600))]
    rows += [("hot", base + timedelta(seconds=500_000), 1000 + i) for i in range(500)]
    rows += [("sparse", base + timedelta(days=int(d) ** 2), 2000 + i) for i, d in enumerate(random.integers(0, 60, 130))]
    rows += [("tiny", base, 3000), ("tiny", base + timedelta(minutes=1), 3001)]
    frame = pd.DataFrame(rows, columns=["k", "t", "s"])
    return frame.assign(x=random.integers(0, 1024, len(frame)) / 8.0).sample(frac=1, random_state=3)


def flat(piece) -> tuple[int, ...]:
    """A slice as a tuple; slices that were cut several times are nested."""
    return (*flat(piece[SLICE]), piece["part"]) if isinstance(piece, dict) else (piece,)


@pytest.mark.parametrize("max_rows", [20, 100, 10_000])
def test_slices_are_ordered_and_bounded(spark, max_rows):
    frame = skewed()
    got = slice_series(spark.createDataFrame(frame), ORDER, max_rows).toPandas()
    assert len(got) == len(frame)
    got[SLICE] = got[SLICE].map(flat)
    for _, series in got.sort_values(["k", "t", "s"]).groupby("k"):
        assert series[SLICE].is_monotonic_increasing
    sizes = got.groupby(["k", SLICE]).size()
    assert sizes.max() <= max_rows
    assert len(sizes) == 3 or max_rows < 10_000


@pytest.mark.parametrize("max_rows", [20, 150, 10_000])
@pytest.mark.parametrize("back", [1, 29, 119])
def test_run_up_holds_the_rows_before_each_slice(spark, max_rows, back):
    frame = skewed()
    got = with_run_up(spark.createDataFrame(frame), back, ORDER, max_rows).toPandas()
    whole = frame.sort_values(["k", "t", "s"])
    got[SLICE] = got[SLICE].map(flat)
    for (key, piece), rows in got.groupby(["k", SLICE]):
        series = whole[whole["k"] == key]["s"].tolist()
        own = rows[~rows["_copy"]].sort_values(["t", "s"])["s"].tolist()
        start = series.index(own[0])
        assert own == series[start : start + len(own)]
        copies = rows[rows["_copy"]].sort_values(["t", "s"])["s"].tolist()
        assert copies == series[max(0, start - back) : start]
    assert (~got["_copy"]).sum() == len(frame)


@pytest.mark.parametrize("max_rows", [25, 10_000])
def test_positions(spark, max_rows):
    frame = skewed()
    got = with_position(spark.createDataFrame(frame), ORDER, max_rows).toPandas().set_index("s")["position"]
    expected = frame.sort_values(["k", "t", "s"]).assign(p=lambda d: d.groupby("k").cumcount() + 1).set_index("s")["p"]
    pd.testing.assert_series_equal(got.sort_index(), expected.sort_index(), check_names=False, check_dtype=False)


def test_null_is_a_key_like_any_other(spark):
    rows = spark.createDataFrame(skewed())
    nulls = rows.withColumn("k", F.nullif("k", F.lit("hot")))
    for run in (lambda df: with_position(df, ORDER, 25), lambda df: with_run_up(df, 29, ORDER, 25).drop(SLICE, "k")):
        a, b = [run(df).drop("k").toPandas().sort_values(["s", *(["_copy"] if "_copy" in run(df).columns else [])]) for df in (rows, nulls)]
        pd.testing.assert_frame_equal(a.reset_index(drop=True), b.reset_index(drop=True))


@pytest.mark.parametrize("max_rows", [25, 10_000])
@pytest.mark.parametrize("minutes", [5, 300])
def test_bursts_and_gaps_equal_brute_force(spark, max_rows, minutes):
    frame = skewed().sort_values(["k", "t", "s"])
    got = alert_bursts(spark.createDataFrame(frame), minutes, ORDER, max_rows).toPandas()
    delta = frame.groupby("k")["t"].diff().dt.total_seconds() / 60
    number = (delta.isna() | (delta > minutes)).cumsum()
    expected = frame.groupby(["k", number]).agg(start=("t", "min"), end=("t", "max"), rows=("s", "size")).reset_index()
    assert sorted(zip(got["k"], got["burst_start"], got["burst_end"], got["rows"])) == sorted(
        zip(expected["k"], expected["start"], expected["end"], expected["rows"]))
    got_gaps = gaps(spark.createDataFrame(frame), ORDER).toPandas().set_index("s")["gap_min"].sort_index()
    np.testing.assert_allclose(got_gaps, delta.set_axis(frame["s"]).sort_index(), equal_nan=True)


def test_bursts_detect_once(spark):
    """Cutting series into slices does not compute the detected rows again, however often it looks at them."""
    calls, frame = spark.sparkContext.accumulator(0), skewed()

    @F.udf("boolean")
    def detected(s):
        calls.add(1)
        return s >= 0

    rows = spark.createDataFrame(frame).filter(detected.asNondeterministic()("s"))
    assert alert_bursts(rows, 5, ORDER, 50).agg(F.sum("rows")).first()[0] == len(frame) == calls.value


def test_gap_of_exactly_the_limit_does_not_split(spark):
    base = datetime(2024, 1, 1)
    rows = [("a", base + timedelta(minutes=m), i) for i, m in enumerate([0, 5, 10, 16])]
    got = alert_bursts(spark.createDataFrame(rows, "k string, t timestamp, s long"), 5, ORDER).toPandas()
    assert sorted(got["rows"]) == [1, 3]


# --- features -------------------------------------------------------------------------


def test_zones_to_rows(spark):
    wide = spark.createDataFrame(raw_frame(10))
    long = zones_to_rows(wide)
    assert long.count() == 50
    assert sorted(r[0] for r in long.select("zone_id").distinct().collect()) == [f"zone_{k}" for k in range(1, 6)]
    with pytest.raises(SchemaValidationError, match="ZONE_TEMP_3"):
        zones_to_rows(wide.drop("ZONE_TEMP_3"))


def test_nulls_of_a_zone_are_kept(spark):
    wide = spark.createDataFrame(raw_frame(4)).withColumn("ZONE_TEMP_2", F.lit(None).cast("double"))
    assert zones_to_rows(wide).filter(F.col("ZONE_TEMP").isNull()).count() == 4


def test_celsius_and_names(spark):
    df = spark.createDataFrame([(32.0, 212.0)], "SA_TEMP double, x double")
    assert fahrenheit_to_celsius(df, ["SA_TEMP", "x"]).first()[:] == (0.0, 100.0)
    with pytest.raises(SchemaValidationError, match="OA_TEMP"):
        fahrenheit_to_celsius(df, ["OA_TEMP"])
    names = normalize(spark.createDataFrame(raw_frame(3))).columns
    assert set(COLUMN_MAP.values()) <= set(names) and {"zone_id", "scenario_file", "fault_type"} <= set(names)


def test_numbers_and_floats(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), (None,)], "v string")
    assert [r[0] for r in numbers(df, ["v"]).collect()] == [1.5, None, None, None]
    assert narrow_floats(spark.range(1).selectExpr("id", "1.1D AS d")).dtypes == [("id", "bigint"), ("d", "float")]


def _expected(long: pd.DataFrame) -> pd.DataFrame:
    long = long.sort_values(["scenario_file", "zone_id", "event_time", "row_seq"]).reset_index(drop=True)
    out = long[["scenario_file", "zone_id", "row_seq"]].copy()
    for c, n in FRAMES:
        rolling = long.groupby(["scenario_file", "zone_id"])[c].rolling(n, min_periods=1)
        out[f"{c}_{n}_mean"] = rolling.mean().to_numpy()
        out[f"{c}_{n}_std"] = rolling.std().fillna(0.0).to_numpy()
    for c in LAG_COLUMNS:
        out[f"{c}_lag1"] = long.groupby(["scenario_file", "zone_id"])[c].shift(1)
    return out


def _two_scenarios() -> pd.DataFrame:
    frame = pd.concat([raw_frame(260), raw_frame(90, "oa_bias_-4_annual.csv", "oa_bias", 7)], ignore_index=True)
    frame.loc[frame.index % 17 == 3, "CHWC_VLV"] = np.nan
    return frame.sample(frac=1, random_state=5)


@pytest.mark.parametrize("max_rows", [40, 10_000])
def test_features_equal_pandas(spark, max_rows):
    wide = spark.createDataFrame(_two_scenarios())
    names = ["scenario_file", "zone_id", "row_seq", *ROLLING_OUTPUTS, *LAG_OUTPUTS]
    from_long = build_features(normalize(wide), max_rows=max_rows).select(names).toPandas()
    from_wide = build_features_from_wide(wide, max_rows=max_rows).select(names).toPandas()
    expected = _expected(control_errors(normalize(numbers(wide, ["CHWC_VLV"]))).toPandas())
    for got in (from_long, from_wide):
        got = got.sort_values(names[:3]).reset_index(drop=True)
        want = expected.sort_values(names[:3]).reset_index(drop=True)
        assert len(got) == 5 * 350
        for c in names[3:]:
            np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-7, atol=1e-6, err_msg=c)


def test_built_in_frames_equal_streamed_ones(spark):
    wide = spark.createDataFrame(_two_scenarios())
    long = control_errors(normalize(numbers(wide, ["CHWC_VLV"])))
    native = add_windows(long, {"m": ("mean", "chwc_valve_pct", 60), "d": ("std", "sf_power_w", 60), "l": ("lag", "oa_damper_pct", 1)}, max_rows=50)
    streamed = build_features(normalize(wide)).select(
        "scenario_file", "zone_id", "row_seq", "chwc_valve_pct_60_mean", "sf_power_w_60_std", "oa_damper_pct_lag1")
    both = native.join(streamed, ["scenario_file", "zone_id", "row_seq"]).toPandas()
    assert len(both) == 5 * 350
    for a, b in (("m", "chwc_valve_pct_60_mean"), ("d", "sf_power_w_60_std"), ("l", "oa_damper_pct_lag1")):
        np.testing.assert_allclose(both[a], both[b], atol=1e-6)


def test_constant_signal_has_no_deviation(spark):
    frame = raw_frame(130)
    frame["SF_WAT"] = np.where(np.arange(130) < 40, frame["SF_WAT"], 0.1)
    std = build_features_from_wide(spark.createDataFrame(frame)).filter("row_seq >= 99").select("sf_power_w_60_std").distinct()
    assert [r[0] for r in std.collect()] == [0.0]


def test_feature_counts_and_missing_columns(spark):
    features = build_features_from_wide(spark.createDataFrame(raw_frame(3)))
    assert len([c for c in features.columns if c not in ("scenario_file", "row_seq")]) == 83
    with pytest.raises(FeatureEngineeringError, match="sf_power_w"):
        build_features(normalize(spark.createDataFrame(raw_frame(3))).drop("sf_power_w"))


# --- sequences ------------------------------------------------------------------------


@pytest.mark.parametrize("max_rows", [25, 10_000])
def test_sequence_windows(spark, max_rows):
    frame = skewed()
    got = sequence_windows(spark.createDataFrame(frame), ["x"], 30, ORDER, max_rows=max_rows).toPandas().set_index("s")
    for key, series in frame.sort_values(["k", "t", "s"]).groupby("k"):
        x, s = series["x"].tolist(), series["s"].tolist()
        for i in range(29, len(x)):
            assert [v[0] for v in got.loc[s[i], "window"]] == x[i - 29 : i + 1]
    assert len(got) == sum(max(0, n - 29) for n in frame.groupby("k").size())


def test_short_series_are_padded_on_request(spark):
    frame = skewed()
    got = sequence_windows(spark.createDataFrame(frame), ["x"], 30, ORDER, pad_short=True, max_rows=25).toPandas()
    tiny = got[got["k"] == "tiny"]
    first, last = frame[frame["k"] == "tiny"].sort_values("t")["x"]
    assert [v[0] for v in tiny["window"].iloc[0]] == [first] * 29 + [last] and len(tiny) == 1


def test_head_takes_the_first_value(spark):
    rows = [("a", i, i, None if i < 3 else float(i)) for i in range(6)]
    df = spark.createDataFrame(rows, "k string, t long, s long, p double")
    assert [r["p"] for r in pad_head(df, "p", ORDER).orderBy("s").collect()] == [3.0, 3.0, 3.0, 3.0, 4.0, 5.0]


def test_last_rows_of_slices_with_nulls_and_repeats(spark):
    """Where the last rows begin is found by key and order alone, of which some may be null or repeat."""
    frame = pd.DataFrame({"k": [None, "a"] * 60, "event_time": [pd.NaT if i % 13 == 0 else pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=i // 4) for i in range(120)],
                          "row_seq": [float("nan") if i % 17 == 0 else i // 2 for i in range(120)], "v": range(120)})
    rows = spark.createDataFrame(frame).withColumn("row_seq", F.nanvl("row_seq", F.lit(None))).withColumn(SLICE, F.col("v") % 3)
    got = _last_rows(rows, 7, Order(keys=("k",))).toPandas()
    assert len(got) == 6 * 7
    for (_, _), part in got.groupby(["k", SLICE], dropna=False):
        assert sorted(part["_from_end"]) == [*range(1, 8)]
        every = frame[(frame["k"].isna() == pd.isna(part["k"].iloc[0])) & (frame["v"] % 3 == part[SLICE].iloc[0])]
        every = every.sort_values(["event_time", "row_seq"], ascending=False, na_position="last")
        want = every.iloc[:7][["event_time", "row_seq"]].reset_index(drop=True)
        have = part.sort_values("_from_end")[["event_time", "row_seq"]].reset_index(drop=True)
        assert ((want == have) | (want.isna() & have.isna())).all().all()


def test_a_slice_of_zone_rows_fits_a_task():
    """Five zones of a slice's rows, in 90 columns of 8 bytes, are at most a quarter of a task's 3,600 MB."""
    assert MAX_ROWS * 5 * 90 * 8 <= 900e6
