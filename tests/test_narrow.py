"""Only what is read is sorted, moved and written; the rows are those of the whole."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from airsleuth.catalog import learned, streams
from airsleuth.detectors.base import RuleDetector
from airsleuth.operators.features import SERIES_INPUTS, _roll, build_features
from airsleuth.operators.ordered import Order, last_rows
from airsleuth.operators.reshape import normalize
from airsleuth.operators.rules import READ, rule_events
from airsleuth.operators.splits import PROTOCOLS, split_of
from airsleuth.plans import hold_out
from airsleuth.plans.detection import detect, fault_scenarios, split_rows
from airsleuth.schema import FEATURES, ROW_KEYS, RUN_COLUMNS, SEQ
from airsleuth.session import cut_lineage
from airsleuth.streaming.streams import RuleStream
from tests.conftest import SF
from tests.frames import raw_frame


def test_frames_end_where_their_series_begins():
    random = np.random.default_rng(3)
    values = pd.DataFrame({c: random.normal(50, 1, 700) for c in SERIES_INPUTS})
    values.iloc[300:450] = 0.7
    values = values.mask(random.random(values.shape) < 0.05)
    group = np.repeat([5, -2, 9, 5], [1, 299, 250, 150])
    got = _roll(values, group)
    for begin, end in ((0, 1), (1, 300), (300, 550), (550, 700)):
        part = values.iloc[begin:end]
        for n in (15, 60, 120):
            frames = part["ra_sa_delta_c"].rolling(n, min_periods=1)
            np.testing.assert_array_equal(got[f"ra_sa_delta_c_{n}_mean"][begin:end], frames.mean())
            np.testing.assert_array_equal(got[f"ra_sa_delta_c_{n}_std"][begin:end], frames.std().fillna(0.0))
        np.testing.assert_array_equal(got["chwc_valve_pct_lag1"][begin:end], part["chwc_valve_pct"].shift(1))


def test_only_wanted_columns_are_rolled():
    random = np.random.default_rng(4)
    values, group = pd.DataFrame({c: random.normal(50, 1, 300) for c in SERIES_INPUTS}), np.repeat([1, 2], 150)
    wanted, whole = ["valve_tracking_err_15_mean", "sf_power_w_60_std", "sf_power_w_lag1"], _roll(values, group)
    wanted = [c for c in wanted if c in whole]
    got = _roll(values[["valve_tracking_err", "sf_power_w"]], group, wanted)
    assert sorted(got) == sorted(wanted) and len(wanted) >= 2
    for c in wanted:
        np.testing.assert_array_equal(got[c], whole[c])


@pytest.mark.parametrize("max_rows", [None, 40])
def test_kept_columns_equal_those_of_the_whole(spark, max_rows):
    rows = normalize(spark.createDataFrame(raw_frame(150)))
    whole, kept = build_features(rows, max_rows=max_rows), build_features(rows, max_rows=max_rows, keep=[*ROW_KEYS, SEQ, *READ])
    assert set(kept.columns) == {*ROW_KEYS, SEQ, *READ}
    assert kept.exceptAll(whole.select(*kept.columns)).isEmpty() and kept.count() == 750


def test_rules_read_what_they_say(spark, features):
    narrow = features.select(*ROW_KEYS, SEQ, "fault_type", *READ)
    assert rule_events(narrow).exceptAll(rule_events(features)).isEmpty() and rule_events(narrow).count() == rule_events(features).count()


def test_runs_write_what_they_read(spark, features):
    rows = learned.run_features(spark, SF)
    assert set(rows.columns) == {*RUN_COLUMNS, "temp_zone_c"}
    assert rows.exceptAll(features.select(*rows.columns)).isEmpty() and rows.count() == features.count()


def test_last_rows_of_series_with_null_keys_and_equal_times(spark):
    at = datetime(2024, 1, 1)
    rows = [("a" if i % 3 else None, at + timedelta(minutes=i // 7), i) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, t timestamp, s long")
    got = last_rows(df, 5, Order(keys=("k",), time="t", seq="s"), ["k"]).collect()
    want = {(k, s, n) for key in ("a", None) for n, (k, _, s) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: r[2])[:-6:-1], 1)}
    assert {(r["k"], r["s"], r["_from_end"]) for r in got} == want and len(got) == 10


def test_a_stream_keeps_only_what_it_reads(spark, tmp_path):
    rows = normalize(spark.createDataFrame(raw_frame(300)))
    stream = RuleStream(spark, str(tmp_path))
    for batch, part in enumerate((rows.filter(F.col(SEQ) < 130), rows.filter(F.col(SEQ) >= 130))):
        stream.process(part, batch)
    kept = spark.read.parquet(f"{tmp_path}/kept/batch=1")
    assert kept.count() == 5 * 119 and not {"temp_zone_c", "rf_power_w", "sys_control_mode"} & set(kept.columns)
    events = stream.events()
    assert events.exceptAll(rule_events(build_features(rows))).isEmpty() and events.count() == rule_events(build_features(rows)).count()


def test_a_quarter_is_a_batch_however_few_rows_it_has(spark, tmp_path, monkeypatch):
    """More files where there are more rows; a quarter with one row is a batch as well."""
    monkeypatch.setattr(streams, "FILE_ROWS", 10)
    frame = raw_frame(91)
    frame.loc[90, "Datetime"] = datetime(2018, 5, 1)
    folder, files = str(tmp_path / "in"), []
    for _ in streams._quarters(spark.createDataFrame(frame), folder):
        files.append(len(spark.read.parquet(folder).inputFiles()))
    assert files[0] == 9 and spark.read.parquet(folder).exceptAll(normalize(spark.createDataFrame(frame))).isEmpty()
    assert spark.read.parquet(folder).count() == 5 * 91


@pytest.mark.parametrize("protocol", sorted(PROTOCOLS))
def test_splits_equal_their_bounds_at_the_edges(spark, protocol):
    bounds = [datetime.fromisoformat(f"2024-{b}") for b in PROTOCOLS[protocol]]
    times = [b + timedelta(seconds=s) for b in bounds for s in (-1, 0, 0.5, 1)] + [datetime(2023, 6, 1), datetime(2025, 6, 1), None]
    df = spark.createDataFrame([(t, y) for t in times for y in (2024, None)], "t timestamp, y int")
    start, train, validation, final = bounds

    def want(t, y):
        if t is None or y is None or not start <= t <= final:
            return None
        return "train" if t <= train else "validation" if t <= validation else "final"

    got = df.withColumn("got", split_of(F.col("t"), F.col("y"), protocol)).collect()
    assert all(r["got"] == want(r["t"], r["y"]) for r in got)


def test_hold_outs_write_the_final_window_alone(spark, features, monkeypatch):
    sizes = []
    monkeypatch.setattr(hold_out, "cut_lineage", lambda df: (written := cut_lineage(df), sizes.append(written.count()))[0])
    hold_out.hold_out_gaussian_summary(features, fault_scenarios(features)[:1]).collect()
    assert max(sizes) < features.count() / 4 and all(c in features.columns for c in FEATURES)


def test_scenarios_held_out_one_by_one_share_the_written_window(spark, features, monkeypatch):
    """Only the final window and the summaries are written, and every split has the rows it had."""
    sizes, seen = [], []
    monkeypatch.setattr(hold_out, "cut_lineage", lambda df: (written := cut_lineage(df), sizes.append(written.count()))[0])

    def rules_only(split):
        seen.append([part.count() for part in (split.train, split.validation, split.evaluation)])
        return detect(split.evaluation, [RuleDetector()])

    names = fault_scenarios(features)[:2]
    hold_out.hold_out_summary(features, names, rules_only, "rules").collect()
    want = [split_rows(features, "common", "final", name, with_normal_reference=True) for name in names]
    assert seen == [[part.count() for part in (s.train, s.validation, s.evaluation)] for s in want]
    assert max(sizes) < features.count() / 4 and len(sizes) == 3
