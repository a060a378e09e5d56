from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from airsleuth.errors import DataLoadError, ReportError, SchemaValidationError, StoreError
from airsleuth.operators.serving import (
    DetectionFilter, PageToken, page_after, token_of, count_detections, daily_view, detection_page, detection_statistics, event_view, filter_detections,
    job_by_id, recent_jobs, register_views, run_view,
)
from airsleuth.plans.detection import run_job
from airsleuth.schema import CACHE_COLUMNS, RAW_COLUMNS
from airsleuth.sources import cache, csv
from airsleuth.sources.store import JobLog, counted, insert_events, read_events, write_report
from tests.frames import raw_frame


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Three scenario files; one has other column order, an extra column and another time format."""
    path = tmp_path_factory.mktemp("scenarios")
    raw_frame(5)[RAW_COLUMNS].to_csv(path / "AHU_annual.csv", index=False)
    stuck = raw_frame(4, seed=1)[RAW_COLUMNS]
    stuck["Datetime"] = stuck["Datetime"].map(lambda t: f"{t.month}/{t.day}/{t.year} {t.hour}:{t.minute:02d}")
    stuck.assign(EXTRA=1)[["EXTRA", *reversed(RAW_COLUMNS)]].to_csv(path / "damper_stuck_010_annual.csv", index=False)
    bad = raw_frame(3, seed=2)[RAW_COLUMNS].astype({"SF_WAT": object})
    bad.loc[1, "SF_WAT"] = "n/a"
    bad.to_csv(path / "coi_stuck_025_annual.csv", index=False)
    return str(path)


@pytest.mark.parametrize("name, fault", [
    ("AHU_annual", "normal"), ("coi_bias_-2_annual", "coi_bias"), ("coi_leakage_010_annual", "coi_leakage"),
    ("COI_stuck_075_annual", "coi_stuck"), ("damper_stuck_100_annual_short", "damper_stuck"), ("oa_bias_-4_annual", "oa_bias"),
])
def test_labels_of_files(spark, name, fault):
    assert csv.infer_fault_type(name) == fault
    assert csv.infer_fault_type(csv.key_for_fault(fault)) == fault
    from airsleuth.functions.columns import fault_of_file, key_of_fault
    row = spark.range(1).select(fault_of_file(F.lit(name)), key_of_fault(F.lit(fault)), fault_of_file(F.lit("unknown_sensor_data"))).first()
    assert tuple(row) == (fault, csv.key_for_fault(fault), None)


def test_parts_with_other_columns(spark, tmp_path):
    """Every part is bound by its own header, and places go on from part to part."""
    folder = tmp_path / "coi_bias_4_annual.csv"
    folder.mkdir()
    first, second = raw_frame(3)[RAW_COLUMNS], raw_frame(2, seed=1)[RAW_COLUMNS]
    first.to_csv(folder / "part-0.csv", index=False)
    second[RAW_COLUMNS[::-1]].to_csv(folder / "part-1.csv", index=False)
    rows = csv.load_all(spark, str(tmp_path)).orderBy("row_seq").collect()
    assert [r["MA_TEMP"] for r in rows] == pytest.approx([*first["MA_TEMP"], *second["MA_TEMP"]])
    assert len({r["row_seq"] for r in rows}) == 5 and {r["scenario_file"] for r in rows} == {"coi_bias_4_annual.csv"}


def test_full_cache_reads_no_source(spark, folder, tmp_path):
    path = str(tmp_path / "cache")
    assert cache.build_cache(spark, folder, path) == 3
    before = spark.read.parquet(path).count()
    assert cache.build_cache(spark, folder, path) == 0 and spark.read.parquet(path).count() == before


def test_unknown_label():
    with pytest.raises(DataLoadError, match="unknown_sensor_data"):
        csv.infer_fault_type("unknown_sensor_data")
    with pytest.raises(DataLoadError):
        csv.key_for_fault("melted")


def test_load_all(spark, folder):
    rows = csv.load_all(spark, folder)
    got = {r["scenario_file"]: r for r in rows.groupBy("scenario_file").agg(
        F.count("*").alias("n"), F.min("fault_type").alias("f"), F.min("Datetime").alias("t"), F.count("SF_WAT").alias("w"),
        F.count_distinct("row_seq").alias("seq"), F.avg("SA_TEMP").alias("sa")).collect()}
    assert {k: (r["n"], r["f"], r["w"], r["seq"]) for k, r in got.items()} == {
        "AHU_annual.csv": (5, "normal", 5, 5), "damper_stuck_010_annual.csv": (4, "damper_stuck", 4, 4),
        "coi_stuck_025_annual.csv": (3, "coi_stuck", 2, 3)}
    assert all(r["t"] == datetime(2018, 1, 1) for r in got.values())
    assert got["damper_stuck_010_annual.csv"]["sa"] == pytest.approx(raw_frame(4, seed=1)["SA_TEMP"].mean())
    ordered = rows.filter("scenario_file = 'AHU_annual.csv'").orderBy("row_seq").select("Datetime").collect()
    assert [r[0].minute for r in ordered] == list(range(5))


def test_choice_of_files(spark, folder):
    assert csv.load_scenario(spark, folder, "coi_stuck").count() == 3
    assert csv.scan_files(spark, folder, "STUCK").count() == 7
    assert csv.scan_files(spark, folder, "all").count() == 12
    with pytest.raises(DataLoadError, match="oa_bias"):
        csv.load_scenario(spark, folder, "oa_bias")
    with pytest.raises(DataLoadError):
        csv.load_all(spark, folder + "/nowhere")


def test_missing_columns_and_unknown_files(spark, tmp_path):
    raw_frame(2)[RAW_COLUMNS].drop(columns=["SA_CFM"]).to_csv(tmp_path / "AHU_annual.csv", index=False)
    with pytest.raises(SchemaValidationError, match="SA_CFM"):
        csv.load_all(spark, str(tmp_path))
    other = tmp_path / "other"
    other.mkdir()
    raw_frame(2)[RAW_COLUMNS].to_csv(other / "mystery.csv", index=False)
    with pytest.raises(DataLoadError, match="mystery"):
        csv.load_all(spark, str(other))


def test_scenario_as_folder_of_parts(spark, tmp_path):
    rows = spark.createDataFrame(raw_frame(50)).repartition(3)
    csv.write_files(rows, str(tmp_path / "out"))
    back = csv.load_all(spark, str(tmp_path / "out"))
    assert back.count() == 50
    assert back.join(rows.select("row_seq", F.col("SA_TEMP").alias("v")), "row_seq").filter("abs(SA_TEMP - v) < 1e-12").count() == 50
    assert back.select("scenario_file").distinct().first()[0] == "AHU_annual.csv"


# --- cache ----------------------------------------------------------------------------


def test_cache_skips_and_forces(spark, tmp_path):
    path = str(tmp_path / "cache")
    make = lambda *names: spark.createDataFrame([(n, float(v)) for n, v in names], "scenario_file string, x double")
    cache.write_cache(make(("a.csv", 1), ("b.csv", 1)), path)
    cache.write_cache(make(("a.csv", 2), ("c.csv", 2)), path)
    read = lambda: {r[0]: r[1] for r in cache.read_cache(spark, path, ["scenario_file", "x"]).collect()}
    assert read() == {"a.csv": 1.0, "b.csv": 1.0, "c.csv": 2.0}
    cache.write_cache(make(("a.csv", 3)), path, force=True)
    assert read() == {"a.csv": 3.0, "b.csv": 1.0, "c.csv": 2.0}
    with pytest.raises(SchemaValidationError, match="absent.*build the cache again"):
        cache.read_cache(spark, path, ["x", "absent"])


def test_cache_files_of_a_folder(spark, tmp_path):
    for name in ("lbnl_features_a.parquet", "lbnl_features.parquet", "other.parquet"):
        spark.range(2).selectExpr("id", "1.5D AS x").coalesce(1).toPandas().to_parquet(tmp_path / name)
    assert cache.read_cache(spark, str(tmp_path), ["x", "x", "id"]).columns == ["x", "id"]
    assert cache.read_cache(spark, str(tmp_path), ["x"]).count() == 2
    (tmp_path / "lbnl_features_a.parquet").rename(tmp_path / "another.parquet")
    assert len(cache.find_cache(spark, str(tmp_path))) == 2
    empty = tmp_path / "empty"
    empty.mkdir()
    with pytest.raises(DataLoadError, match="build the cache"):
        cache.read_cache(spark, str(empty))


def test_column_lists():
    assert len(cache.column_list(None)) == 40 == len(set(CACHE_COLUMNS))
    for bad in ([], ['a"b'], [""]):
        with pytest.raises(DataLoadError):
            cache.column_list(bad)


def test_projection_reaches_the_scan(spark, features, tmp_path):
    path = str(tmp_path / "cache")
    cache.write_cache(features, path, as_floats=False)
    plan = cache.read_cache(spark, path, ["zone_id", "sf_power_w"], scenario="AHU_annual.csv")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<sf_power_w:double,zone_id:string>" in plan
    assert "PartitionFilters: [isnotnull(scenario_file" in plan


# --- stores ---------------------------------------------------------------------------

EVENT = ("event_time timestamp, zone_id string, equipment_id string, detector_source string, violated_policy string, trigger_signal string, "
         "anomaly_index double, alert_level string, ground_truth string, predicted_fault string, confidence double")


def _three(spark):
    day = datetime(2024, 6, 1)
    return spark.createDataFrame([
        (day + timedelta(hours=10), "ZONE-1", "AHU-1", "rules", "P", "s", 1.0, "CRITICAL", None, None, None),
        (day + timedelta(hours=11), "ZONE-2", "AHU-1", "rules", "P", "s", 2.0, "WARNING", None, "", None),
        (day + timedelta(hours=12), "ZONE-1", "AHU-2", "rules", "P", "s", 3.0, "INFO", "normal", "oa_bias", 0.5),
    ], EVENT)


def test_event_store(spark, tmp_path):
    path = str(tmp_path / "events")
    assert insert_events(_three(spark), path) == 3
    assert insert_events(_three(spark).limit(0), path) == 0
    events = read_events(spark, path)
    at = lambda h, m=0: datetime(2024, 6, 1, h, m)
    assert count_detections(events, DetectionFilter(start=at(10, 30), end=at(11, 30))).first()[0] == 1
    assert count_detections(events, DetectionFilter(start=at(10), end=at(12))).first()[0] == 3
    assert count_detections(events, DetectionFilter(zone_id="ZONE-1", alert_level="INFO")).first()[0] == 1
    assert count_detections(events, DetectionFilter(fault_type="oa_bias")).first()[0] == 1
    assert [e["event_time"].hour for e in detection_page(events).collect()] == [12, 11, 10]
    assert [e["event_time"].hour for e in detection_page(events, page_size=2, skip=2).collect()] == [10]
    for wrong in ({"page_size": 0}, {"page_size": 1001}, {"skip": -1}):
        with pytest.raises(ValueError):
            detection_page(events, **wrong)
    deep = detection_page(events, page_size=1, skip=1, seek_beyond=0)
    assert [e["event_time"].hour for e in deep.collect()] == [11]
    assert "PartitionFilters: [isnotnull(event_date" in deep._jdf.queryExecution().executedPlan().toString()
    plan = filter_detections(events, DetectionFilter(start=at(10), end=at(12)))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    stats = {(r["dimension"], r["value"]): r["detections"] for r in detection_statistics(events).collect()}
    assert stats == {("total", None): 3, ("alert_level", "CRITICAL"): 1, ("alert_level", "WARNING"): 1, ("alert_level", "INFO"): 1,
                     ("fault_type", "unknown"): 2, ("fault_type", "oa_bias"): 1, ("equipment", "AHU-1"): 2, ("equipment", "AHU-2"): 1}
    assert daily_view(event_view(events)).count() == 3
    with pytest.raises(StoreError):
        read_events(spark, path + "-nowhere").count()


def test_deep_pages_equal_shallow_ones(spark):
    events = spark.range(5000).selectExpr("id", "timestamp_micros(1700000000000000 + (id * 7919 % 5000) * 60000000) AS event_time")
    for skip in (0, 1234, 4990, 6000):
        shallow = detection_page(events, page_size=20, skip=skip).collect()
        assert detection_page(events, page_size=20, skip=skip, seek_beyond=-1).collect() == shallow
        assert len(shallow) == max(0, min(20, 5000 - skip))


def test_pages_by_token_give_the_whole_table(spark):
    """Many rows share an instant, so that pages end inside one; rows that arrive later move no page."""
    events = spark.range(90).selectExpr("xxhash64(id) AS id", "timestamp_micros(1700000000000000 + id div 25 * 1000001) AS event_time").cache()
    whole = [tuple(r) for r in events.orderBy(F.desc("event_time"), F.desc("id")).collect()]
    got, token, now = [], None, events
    while page := [tuple(r) for r in page_after(now, token, page_size=20).collect()]:
        got += page
        token = PageToken(page[-1][1], page[-1][0])
        now = events.unionByName(spark.sql("SELECT 7L AS id, timestamp'2030-01-01' AS event_time"))
    assert got == whole and token_of(events.limit(0)) is None
    assert token_of(page_after(events, page_size=20)) == PageToken(whole[19][1], whole[19][0])
    assert "TakeOrderedAndProject" in page_after(events, token)._jdf.queryExecution().executedPlan().toString()
    for wrong in (0, 1001):
        with pytest.raises(ValueError):
            page_after(events, page_size=wrong)


def test_deep_page_among_rows_of_one_instant(spark):
    """Ids are hashes, as in the store, so that ranges of ids can be left out."""
    events = spark.range(3000).selectExpr("xxhash64(id) AS id", "timestamp_micros(1700000000000000 + IF(id < 2900, 0, id)) AS event_time")
    for skip in (50, 1500, 2990):
        shallow = detection_page(events, page_size=30, skip=skip).collect()
        assert detection_page(events, page_size=30, skip=skip, seek_beyond=10).collect() == shallow


def test_job_log(spark, folder, tmp_path):
    log = JobLog(spark, str(tmp_path / "jobs"))
    assert log.jobs().count() == 0
    first, second = log.create("all"), log.create("stuck")
    assert second == first + 1
    log.update(first, "running")
    assert job_by_id(log.jobs(), first).first()["finished_at"] is None
    log.update(first, "failed", error_msg="boom")
    job = job_by_id(log.jobs(), first).first()
    assert (job["status"], job["error_msg"], job["scenario"]) == ("failed", "boom", "all") and job["finished_at"] is not None
    with pytest.raises(StoreError, match="99"):
        log.update(99, "done")
    assert [j["id"] for j in recent_jobs(log.jobs(), 1).collect()] == [second]
    third = run_job(spark, log, folder, "stuck")
    done = job_by_id(log.jobs(), third).first()
    assert (done["status"], done["records_processed"], done["anomalies_found"]) == ("done", 35, 0)
    with pytest.raises(DataLoadError):
        run_job(spark, log, folder, "nothing")
    assert recent_jobs(log.jobs(), 1).first()["status"] == "failed"
    assert run_view(log.jobs()).filter("duration_sec >= 0").count() == 3
    register_views(read_events(spark, _stored(spark, tmp_path)), log.jobs())
    assert spark.sql("SELECT sum(detection_count) FROM vw_detection_daily").first()[0] == 3


def test_jobs_created_together(spark, tmp_path):
    """Writers at the same time get ids of their own in a row, and every transition its place."""
    log = JobLog(spark, str(tmp_path / "jobs"))
    with ThreadPoolExecutor(6) as pool:
        ids = list(pool.map(lambda i: JobLog(spark, str(tmp_path / "jobs")).create(f"s{i}"), range(12)))
    assert sorted(ids) == list(range(1, 13))
    assert sorted(r["seq"] for r in log.transitions().collect()) == list(range(1, 13))
    assert {j["id"]: j["scenario"] for j in log.jobs().collect()} == {job: f"s{i}" for i, job in enumerate(ids)}


def test_compacted_log(spark, tmp_path):
    log = JobLog(spark, str(tmp_path / "jobs"))
    assert log.compact() == 0
    first = log.create("a")
    log.update(first, "running")
    second = log.create("b")
    log.update(first, "done", records_processed=7)
    before = sorted(map(str, log.jobs().collect()))
    assert log.compact() == 4 and sorted(map(str, log.jobs().collect())) == before and log.compact() == 0
    assert log.create("c") == second + 1
    log.update(second, "failed", error_msg="late")
    assert [r["seq"] for r in log.transitions().orderBy("seq").collect()] == [1, 2, 3, 4, 5, 6]
    assert log.compact() == 3 and job_by_id(log.jobs(), second).first()["error_msg"] == "late"
    assert [j["id"] for j in recent_jobs(log.jobs(), 5).collect()] == [3, 2, 1]


def _stored(spark, tmp_path) -> str:
    path = str(tmp_path / uuid.uuid4().hex)
    insert_events(_three(spark), path)
    return path


def test_reports_and_counts(spark, tmp_path):
    metrics = spark.createDataFrame([("a", 0.5), ("b", None)], "label string, f1 double")
    write_report(metrics, str(tmp_path / "report"))
    assert spark.read.schema(metrics.schema).json(str(tmp_path / "report")).orderBy("label").collect() == metrics.collect()
    with pytest.raises(ReportError, match="xml"):
        write_report(metrics, str(tmp_path / "report"), ["xml"])
    rows, seen = counted(metrics)
    rows.collect()
    assert seen.get["rows"] == 2
