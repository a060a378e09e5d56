"""Queries of sources, sinks, projections, splits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airsleuth.catalog.base import (
    DETECTIONS, ERRORS, FEATURE_ROWS, HITS, LONG, WIDE, detections, features, frame, long, micros, query, r6,
    rounded, wide, with_sql,
)
from airsleuth.detectors.base import RuleDetector
from airsleuth.functions.columns import (
    alert_level, fault_family, fault_of_file, key_of_fault, known_fault, known_level, or_unknown, parse_time, severity,
    to_double,
)
from airsleuth.operators.contract import check_contract, reject_reason, to_events
from airsleuth.operators.features import add_windows, control_errors
from airsleuth.operators.ordered import Order
from airsleuth.operators.reshape import fahrenheit_to_celsius, narrow_floats, zones_to_rows
from airsleuth.operators.splits import (
    complete_rows, contiguous_tail, normal_rows, only_scenario, sample_at_most, sample_for_mixture,
    sample_per_scenario, temporal_split, without_scenario,
)
from airsleuth.operators.serving import job_by_id
from airsleuth.plans.detection import run_job
from airsleuth.schema import CACHE_COLUMNS, COLUMN_MAP, FEATURES, RAW_COLUMNS, SCENARIO, SEQ
from airsleuth.session import scratch_path
from airsleuth.sources.cache import not_cached, read_cache, write_cache, write_combined
from airsleuth.sources.csv import load_all, load_scenario, scan_files, write_files
from airsleuth.sources.store import (
    JobLog, counted, ingest_counts, insert_events, latest_jobs, read_events, write_report,
)

ROW = "scenario_file, zone_id, row_seq"

# --- sources and sinks ------------------------------------------------------------


def _scenario_folder(spark: SparkSession, sf_dir: str) -> str:
    folder = scratch_path(spark, "scenarios")
    write_files(wide(spark, sf_dir), folder)
    return folder


_RAW = [c for c in RAW_COLUMNS if c != "Datetime"]
_RAW_SQL = f"""SELECT scenario_file, fault_type, row_seq, epoch_us("Datetime") AS event_us, {', '.join(_RAW)} FROM wide"""


def _raw(df: DataFrame) -> DataFrame:
    return df.select(SCENARIO, "fault_type", SEQ, micros("Datetime").alias("event_us"), *_RAW)


@query("s1_load_all", with_sql(WIDE, _RAW_SQL))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(load_all(spark, _scenario_folder(spark, sf_dir)))


@query("s2_load_scenario", with_sql(WIDE, f"{_RAW_SQL} WHERE fault_type = 'coi_bias'"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(load_scenario(spark, _scenario_folder(spark, sf_dir), "coi_bias"))


@query("s3_scan_files", with_sql(WIDE, f"{_RAW_SQL} WHERE contains(lower(scenario_file), 'stuck')"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(scan_files(spark, _scenario_folder(spark, sf_dir), "STUCK"))


@query("s4_label_of_file", with_sql(WIDE, "SELECT scenario_file, fault_type AS label, count(*) AS n FROM wide GROUP BY ALL"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide(spark, sf_dir).groupBy(SCENARIO, fault_of_file(F.col(SCENARIO)).alias("label")).agg(F.count("*").alias("n"))


@query("s5_file_key_of_label", with_sql(WIDE, """
SELECT fault_type, CASE fault_type WHEN 'normal' THEN 'ahu_annual' ELSE fault_type END AS file_key, count(*) AS n
FROM wide GROUP BY ALL"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide(spark, sf_dir).groupBy("fault_type", key_of_fault(F.col("fault_type")).alias("file_key")).agg(
        F.count("*").alias("n"))


@query("s7_typed_times", """
SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE epoch_us(date_trunc('minute', ts)) END AS parsed_us FROM events""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    minute = F.date_trunc("minute", "ts")
    text = (
        F.when(F.col("event_id") % 3 == 0, F.date_format(minute, "yyyy-MM-dd HH:mm:ss"))
        .when(F.col("event_id") % 3 == 1, F.date_format(minute, "M/d/yyyy H:mm")).otherwise(F.lit("not a time"))
    )
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts")
    return events.select("event_id", F.unix_micros(parse_time(text)).alias("parsed_us"))


_CACHE_CHECK = ["valve_tracking_err_15_mean", "sf_power_w_60_mean", "chwc_valve_pct_lag1"]
_CACHE_SQL = f"""
SELECT {ROW}, {', '.join(r6(f'CAST({c} AS FLOAT)::DOUBLE', c, 4) for c in _CACHE_CHECK)} FROM features"""


@query("s8_cache_by_scenario", with_sql(FEATURE_ROWS, f"{_CACHE_SQL} WHERE scenario_file <> 'AHU_annual.csv'"
       " UNION ALL SELECT scenario_file, zone_id, row_seq, -1e0, -1e0, -1e0 FROM features WHERE scenario_file = 'AHU_annual.csv'"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scenario is in the cache already, with other values; it is skipped, the others are added."""
    path, rows = scratch_path(spark, "cache"), features(spark, sf_dir)
    old = rows.filter(F.col(SCENARIO) == "AHU_annual.csv").withColumns({c: F.lit(-1.0) for c in _CACHE_CHECK})
    write_cache(old, path)
    write_cache(rows, path)
    cached = read_cache(spark, path, [SCENARIO, "zone_id", SEQ, *_CACHE_CHECK])
    return rounded(cached.withColumns({c: F.col(c).cast("double") for c in _CACHE_CHECK}), *_CACHE_CHECK, digits=4)


@query("s9_cache_combined", with_sql(FEATURE_ROWS, _CACHE_SQL))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "combined")
    write_combined(features(spark, sf_dir), path)
    cached = read_cache(spark, path, [SCENARIO, "zone_id", SEQ, *_CACHE_CHECK])
    return rounded(cached.withColumns({c: F.col(c).cast("double") for c in _CACHE_CHECK}), *_CACHE_CHECK, digits=4)


_PROJECTED = [c for c in CACHE_COLUMNS if c not in ("event_time", "zone_id", "fault_type")]


@query("s10_projected_read", with_sql(FEATURE_ROWS, f"""
SELECT epoch_us(event_time) AS event_us, zone_id, fault_type, {', '.join(r6(c, digits=6) for c in _PROJECTED)} FROM features"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "cache")
    write_cache(features(spark, sf_dir), path, as_floats=False)
    rows = read_cache(spark, path)
    return rounded(rows.withColumn("event_us", micros("event_time")).drop("event_time"), *_PROJECTED, digits=6)


@query("s14_insert_events", with_sql(DETECTIONS, """
SELECT strftime(event_time, '%Y-%m-%d') AS event_date, alert_level, count(*) AS n,
  round(sum(anomaly_index), 4) AS index_sum FROM detections GROUP BY ALL"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "events")
    insert_events(detections(spark, sf_dir), path)
    return read_events(spark, path).groupBy(F.col("event_date").cast("string").alias("event_date"), "alert_level").agg(
        F.count("*").alias("n"), F.round(F.sum("anomaly_index"), 4).alias("index_sum"))


def _job_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is a job: pending, running, and for settled ones done or failed."""
    start = F.col("o_orderdate").cast("timestamp")
    end = F.timestamp_micros(F.unix_micros(start) + (F.col("o_orderkey") % 600 + 1) * 1_000_000)
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "failed")

    def step(seq: int, state: str | F.Column, **values: F.Column) -> F.Column:
        field = lambda n, t: values.get(n, F.lit(None)).cast(t).alias(n)
        return F.struct(
            F.lit(seq).cast("long").alias("seq"), (F.lit(state) if isinstance(state, str) else state).alias("status"),
            field("error_msg", "string"), field("started_at", "timestamp"), field("finished_at", "timestamp"),
            field("records_processed", "long"), field("anomalies_found", "long"),
        )

    steps = F.array(
        step(1, "pending", started_at=start), step(2, "running"),
        F.when(status.isNotNull(), step(
            3, status, finished_at=end, error_msg=F.when(status == "failed", F.lit("stopped")),
            records_processed=F.when(status == "done", F.floor("o_totalprice")),
            anomalies_found=F.when(status == "done", F.lit(0)),
        )),
    )
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("scenario"), F.explode(F.array_compact(steps)).alias("s")
    ).select("id", "scenario", "s.*")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_jobs(_job_transitions(spark, sf_dir))


JOBS = """
jobs AS (
  SELECT o_orderkey AS id, o_orderpriority AS scenario,
    CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'failed' ELSE 'running' END AS status,
    CASE WHEN o_orderstatus = 'O' THEN 'stopped' END AS error_msg,
    epoch_us(o_orderdate) AS started_us,
    CASE WHEN o_orderstatus IN ('F', 'O') THEN epoch_us(o_orderdate) + (o_orderkey % 600 + 1) * 1000000 END AS finished_us,
    CASE WHEN o_orderstatus = 'F' THEN CAST(floor(o_totalprice) AS BIGINT) END AS records_processed,
    CASE WHEN o_orderstatus = 'F' THEN 0::BIGINT END AS anomalies_found
  FROM orders)"""


@query("s15_latest_jobs", with_sql(JOBS, "SELECT * FROM jobs"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = {"started_us": micros("started_at"), "finished_us": micros("finished_at")}
    return jobs(spark, sf_dir).withColumns(times).drop("started_at", "finished_at")


@query("s15_whole_run", with_sql(HITS, """
SELECT ground_truth, alert_level, count(*) AS stored, 'done' AS status, (SELECT count(*) FROM long) AS records_processed,
  (SELECT count(*) FROM rule_events) AS anomalies_found FROM rule_events GROUP BY ALL"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenario files to stored events and reports under a job; the store is read back beside the job."""
    log = JobLog(spark, scratch_path(spark, "jobs"))
    events, reports = scratch_path(spark, "events"), scratch_path(spark, "reports")
    job = run_job(spark, log, _scenario_folder(spark, sf_dir), detectors=[RuleDetector()], events_path=events, reports_path=reports)
    done = job_by_id(log.jobs(), job).first()
    return read_events(spark, events).groupBy("ground_truth", "alert_level").agg(F.count("*").alias("stored")).select(
        "*", *[F.lit(done[c]).alias(c) for c in ("status", "records_processed", "anomalies_found")])


@query("s16_report_file", with_sql(DETECTIONS, """
SELECT alert_level, count(*) AS n, round(avg(confidence), 4) AS mean_confidence FROM detections GROUP BY ALL"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "report")
    report = detections(spark, sf_dir).groupBy("alert_level").agg(
        F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("mean_confidence"))
    write_report(report, path)
    return spark.read.schema(report.schema).json(path)


@query("s18_ingest_counts", with_sql(WIDE, """
SELECT count(*) * 5 AS rows, count(DISTINCT scenario_file) AS frames, 83 + 2 AS columns FROM wide"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """83 columns of the feature frame, and the file name and row number."""
    return ingest_counts(features(spark, sf_dir))


@query("a17_run_totals", with_sql(DETECTIONS, """
SELECT count(*) AS records_processed, count(*) FILTER (alert_level = 'CRITICAL') AS anomalies_found FROM detections"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, seen = counted(detections(spark, sf_dir))
    found = rows.filter(F.col("alert_level") == "CRITICAL").agg(F.count("*").alias("anomalies_found"))
    total = found.first()["anomalies_found"]
    return spark.range(1).select(
        F.lit(seen.get["rows"]).cast("long").alias("records_processed"), F.lit(total).cast("long").alias("anomalies_found"))


# --- projections ------------------------------------------------------------------


@query("p1_zones_to_rows", with_sql(WIDE, " UNION ALL ".join(
    f"SELECT scenario_file, row_seq, 'zone_{k}' AS zone_id, ZONE_TEMP_{k} AS ZONE_TEMP FROM wide" for k in range(1, 6))))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones_to_rows(wide(spark, sf_dir)).select(SCENARIO, SEQ, "zone_id", "ZONE_TEMP")


@query("p2_celsius", with_sql(WIDE, f"""
SELECT scenario_file, row_seq, {', '.join(r6(f'({c} - 32) * 5 / 9', c) for c in ('SA_TEMP', 'RA_TEMP', 'MA_TEMP', 'OA_TEMP'))} FROM wide"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["SA_TEMP", "RA_TEMP", "MA_TEMP", "OA_TEMP"]
    return rounded(fahrenheit_to_celsius(wide(spark, sf_dir), names), *names).select(SCENARIO, SEQ, *names)


@query("p3_normalized_names", with_sql(LONG, f"SELECT {ROW}, fault_type, {', '.join(r6(c) for n, c in COLUMN_MAP.items() if n != 'Datetime')} FROM long"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [c for n, c in COLUMN_MAP.items() if n != "Datetime"]
    return rounded(long(spark, sf_dir), *names).select(SCENARIO, "zone_id", SEQ, "fault_type", *names)


@query("p4_tracking_errors", with_sql(ERRORS, f"""
SELECT {ROW}, valve_tracking_err, damper_tracking_err, sf_tracking_err FROM errors"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control_errors(long(spark, sf_dir)).select(
        SCENARIO, "zone_id", SEQ, "valve_tracking_err", "damper_tracking_err", "sf_tracking_err")


_DELTAS = ["sa_temp_error_c", "ma_oa_delta_c", "ra_sa_delta_c", "sa_oa_temp_diff_c"]


@query("p5_temperature_deltas", with_sql(ERRORS, f"SELECT {ROW}, {', '.join(r6(c) for c in _DELTAS)} FROM errors"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(control_errors(long(spark, sf_dir)), *_DELTAS).select(SCENARIO, "zone_id", SEQ, *_DELTAS)


@query("p6_numbers", """
SELECT event_id, TRY_CAST(CASE event_id % 4 WHEN 0 THEN 'n/a' WHEN 1 THEN '' ELSE CAST(event_id AS VARCHAR) || '.5' END AS DOUBLE) AS number
FROM events""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    text = F.when(e % 4 == 0, "n/a").when(e % 4 == 1, "").otherwise(F.concat(e.cast("string"), F.lit(".5")))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", text.alias("number"))
    return events.select("event_id", to_double("number").alias("number"))


@query("p7_narrow_floats", with_sql(LONG, f"SELECT {ROW}, {r6('CAST(temp_supply_celsius AS FLOAT)::DOUBLE', 'temp_supply_celsius', 4)} FROM long"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow = narrow_floats(long(spark, sf_dir))
    wide_again = narrow.withColumn("temp_supply_celsius", F.col("temp_supply_celsius").cast("double"))
    return rounded(wide_again, "temp_supply_celsius", digits=4).select(SCENARIO, "zone_id", SEQ, "temp_supply_celsius")


@query("p9_alert_level", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_discount >= 0.08e0 THEN 'CRITICAL' WHEN l_discount >= 0.04e0 THEN 'WARNING' ELSE 'INFO' END AS alert_level
FROM lineitem""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return items.select("l_orderkey", "l_linenumber", alert_level(F.col("l_discount"), 0.04, 0.08).alias("alert_level"))


@query("p10_worst_level", with_sql(DETECTIONS, """
SELECT zone_id, equipment_id,
  max(CASE alert_level WHEN 'INFO' THEN 0 WHEN 'WARNING' THEN 1 WHEN 'CRITICAL' THEN 2 END)::BIGINT AS worst_rank,
  arg_max(alert_level, CASE alert_level WHEN 'INFO' THEN 0 WHEN 'WARNING' THEN 1 ELSE 2 END) AS worst
FROM detections GROUP BY ALL"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = severity(F.col("alert_level"))
    return detections(spark, sf_dir).groupBy("zone_id", "equipment_id").agg(
        F.max(rank).cast("long").alias("worst_rank"), F.max_by("alert_level", rank).alias("worst"))


_WHOLE = " AND ".join(f"{c} IS NOT NULL" for c in FEATURES)


@query("p11_complete_rows", with_sql(FEATURE_ROWS, f"SELECT {ROW} FROM features WHERE {_WHOLE}"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complete_rows(features(spark, sf_dir)).select(SCENARIO, "zone_id", SEQ)


@query("p12_training_rows", with_sql(FEATURE_ROWS, f"""
SELECT scenario_file, fault_type, count(*) AS n FROM features
WHERE {_WHOLE} AND fault_type IS NOT NULL AND scenario_file IS NOT NULL GROUP BY ALL"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complete_rows(features(spark, sf_dir), ["fault_type", SCENARIO]).groupBy(SCENARIO, "fault_type").agg(
        F.count("*").alias("n"))


@query("p13_normal_rows", with_sql(LONG, f"SELECT {ROW} FROM long WHERE fault_type = 'normal'"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normal_rows(long(spark, sf_dir)).select(SCENARIO, "zone_id", SEQ)


def _split_sql(start: str, train: str, validation: str, final: str) -> str:
    bound = lambda text: f"CAST(base_year || '-{text}' AS TIMESTAMP)"
    return f"""
split_rows AS (
  SELECT *, CASE WHEN event_time >= {bound(start)} AND event_time <= {bound(train)} THEN 'train'
    WHEN event_time > {bound(train)} AND event_time <= {bound(validation)} THEN 'validation'
    WHEN event_time > {bound(validation)} AND event_time <= {bound(final)} THEN 'final' END AS split
  FROM (SELECT *, min(year(event_time)) OVER (PARTITION BY scenario_file) AS base_year FROM long))"""


ANNUAL = _split_sql("01-01 00:00:00", "09-30 23:59:59", "11-30 23:59:59", "12-31 23:59:59")
COMMON = _split_sql("04-01 00:00:00", "08-31 23:59:59", "09-30 23:59:59", "10-31 23:59:59")


@query("p14_annual_split", with_sql(f"{LONG}, {ANNUAL}", f"SELECT {ROW}, split FROM split_rows"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal_split(long(spark, sf_dir), "annual").select(SCENARIO, "zone_id", SEQ, "split")


@query("p15_common_split", with_sql(f"{LONG}, {COMMON}", f"SELECT {ROW}, split FROM split_rows"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal_split(long(spark, sf_dir), "common").select(SCENARIO, "zone_id", SEQ, "split")


@query("p16_split_windows", with_sql(f"{LONG}, {ANNUAL}", """
SELECT split, scenario_file, count(*) AS n, min(epoch_us(event_time)) AS first_us, max(epoch_us(event_time)) AS last_us
FROM split_rows WHERE split IS NOT NULL GROUP BY ALL"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = temporal_split(long(spark, sf_dir), "annual").filter(F.col("split").isNotNull())
    return rows.groupBy("split", SCENARIO).agg(
        F.count("*").alias("n"), F.min(micros("event_time")).alias("first_us"), F.max(micros("event_time")).alias("last_us"))


_HELD = "coi_stuck_075_annual.csv"


@query("p17_hold_out", with_sql(LONG, f"""
SELECT 'train' AS side, scenario_file, count(*) AS n FROM long WHERE scenario_file <> '{_HELD}' GROUP BY ALL
UNION ALL
SELECT 'evaluate' AS side, scenario_file, count(*) AS n FROM long
WHERE scenario_file IN ('{_HELD}', 'AHU_annual.csv') GROUP BY ALL"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = long(spark, sf_dir)
    train = without_scenario(rows, _HELD).withColumn("side", F.lit("train"))
    evaluate = only_scenario(rows, _HELD, with_normal_reference=True).withColumn("side", F.lit("evaluate"))
    return train.unionByName(evaluate).groupBy("side", SCENARIO).agg(F.count("*").alias("n"))


@query("p20_default_fill", with_sql(DETECTIONS, """
SELECT id, coalesce(predicted_fault, 'normal') AS predicted_fault, coalesce(confidence > 0.5e0, false) AS detected FROM detections"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).select(
        "id", F.coalesce("predicted_fault", F.lit("normal")).alias("predicted_fault"),
        F.coalesce(F.col("confidence") > 0.5, F.lit(False)).alias("detected"))


@query("p21_unknown_labels", with_sql(DETECTIONS, """
SELECT id, coalesce(nullif(ground_truth, ''), 'unknown') AS ground_truth, coalesce(nullif(predicted_fault, ''), 'unknown') AS predicted_fault
FROM detections"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).select(
        "id", or_unknown(F.col("ground_truth")).alias("ground_truth"), or_unknown(F.col("predicted_fault")).alias("predicted_fault"))


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events some of which break the contract in one way or another."""
    i = F.col("id")
    events = detections(spark, sf_dir).withColumns({
        "zone_id": F.when(i % 13 == 0, "").when(i % 13 == 1, F.repeat(F.lit("z"), F.lit(33))).otherwise(F.col("zone_id")),
        "anomaly_index": F.when(i % 11 == 0, -F.col("anomaly_index") - 1).otherwise(F.col("anomaly_index")),
        "confidence": F.when(i % 17 == 2, F.lit(1.5)).otherwise(F.col("confidence")),
        "alert_level": F.when(i % 19 == 0, F.lit("SEVERE")).otherwise(F.col("alert_level")),
    })
    return events


BROKEN = DETECTIONS + """,
broken AS (
  SELECT * REPLACE (
    CASE id % 13 WHEN 0 THEN '' WHEN 1 THEN repeat('z', 33) ELSE zone_id END AS zone_id,
    CASE WHEN id % 11 = 0 THEN -anomaly_index - 1 ELSE anomaly_index END AS anomaly_index,
    CASE WHEN id % 17 = 2 THEN 1.5e0 ELSE confidence END AS confidence,
    CASE WHEN id % 19 = 0 THEN 'SEVERE' ELSE alert_level END AS alert_level)
  FROM detections)"""


@query("p22_event_contract", with_sql(BROKEN, """
SELECT id, CASE WHEN length(zone_id) NOT BETWEEN 1 AND 32 THEN 'zone_id'
  WHEN anomaly_index < 0 THEN 'anomaly_index'
  WHEN alert_level NOT IN ('INFO', 'WARNING', 'CRITICAL') THEN 'alert_level'
  WHEN predicted_fault = '' THEN 'predicted_fault'
  WHEN confidence NOT BETWEEN 0 AND 1 THEN 'confidence' END AS reason
FROM broken"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _broken(spark, sf_dir).select("id", reject_reason().alias("reason"))


@query("p22_contract_counts", with_sql(BROKEN, """
SELECT CASE WHEN length(zone_id) NOT BETWEEN 1 AND 32 OR anomaly_index < 0
    OR alert_level NOT IN ('INFO', 'WARNING', 'CRITICAL') OR coalesce(predicted_fault = '', false)
    OR coalesce(confidence NOT BETWEEN 0 AND 1, false) THEN 'rejected' ELSE 'stored' END AS outcome, count(*) AS n
FROM broken GROUP BY ALL"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, rejected = check_contract(to_events(_broken(spark, sf_dir)))
    return valid.agg(F.count("*").alias("n")).withColumn("outcome", F.lit("stored")).unionByName(
        rejected.agg(F.count("*").alias("n")).withColumn("outcome", F.lit("rejected")))


@query("p23_lenient_parse", with_sql(BROKEN, """
SELECT id, CASE WHEN alert_level IN ('INFO', 'WARNING', 'CRITICAL') THEN alert_level ELSE 'INFO' END AS alert_level,
  nullif(predicted_fault, '') AS predicted_fault FROM broken"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _broken(spark, sf_dir).select(
        "id", known_level(F.col("alert_level")).alias("alert_level"), known_fault(F.col("predicted_fault")).alias("predicted_fault"))


@query("p24_constant_tags", with_sql(DETECTIONS, "SELECT id, 'AHU-1' AS equipment_id, detector_source, violated_policy FROM detections"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = to_events(detections(spark, sf_dir).withColumn("trigger_signal", F.col("id").cast("string")))
    return tagged.select(F.col("trigger_signal").cast("long").alias("id"), "equipment_id", "detector_source", "violated_policy")


@query("p27_fault_family", with_sql(WIDE, """
SELECT fault_type, CASE WHEN contains(fault_type, 'bias') THEN 'sensor_bias' WHEN contains(fault_type, 'stuck') THEN 'actuator_stuck'
  WHEN contains(fault_type, 'leakage') THEN 'actuator_leakage' ELSE 'unknown' END AS family, count(*) AS n FROM wide GROUP BY ALL"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide(spark, sf_dir).groupBy("fault_type", fault_family(F.col("fault_type")).alias("family")).agg(F.count("*").alias("n"))


# --- samples ----------------------------------------------------------------------

_IDS = ["row_seq", "zone_id"]


def _draw_sql(seed: str) -> str:
    return f"md5(concat_ws('|', {seed}, row_seq, zone_id))"


@query("m1_sample_share", with_sql(LONG, f"""
SELECT {ROW} FROM (SELECT *, row_number() OVER (ORDER BY {_draw_sql('42')}, row_seq, zone_id) AS place, count(*) OVER () AS total
  FROM long WHERE fault_type = 'normal')
WHERE place <= CASE WHEN total > 1000 THEN floor(total * 0.2e0) ELSE total END"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_for_mixture(normal_rows(long(spark, sf_dir)), _IDS, 42, above=1000).select(SCENARIO, "zone_id", SEQ)


@query("m2_sample_at_most", with_sql(LONG, f"SELECT {ROW} FROM long ORDER BY {_draw_sql('42')}, row_seq, zone_id LIMIT 3000"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_at_most(long(spark, sf_dir), 3000, _IDS, 42).select(SCENARIO, "zone_id", SEQ)


@query("m3_sample_per_scenario", with_sql(LONG, f"""
SELECT {ROW} FROM (
  SELECT *, row_number() OVER (PARTITION BY scenario_file ORDER BY {_draw_sql('42 + scenario_no')}, row_seq, zone_id) AS place,
    count(*) OVER (PARTITION BY scenario_file) AS total
  FROM (SELECT *, dense_rank() OVER (ORDER BY scenario_file) - 1 AS scenario_no FROM long))
WHERE place <= round_even(total * 0.2e0, 0)"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_per_scenario(long(spark, sf_dir), _IDS, 42).select(SCENARIO, "zone_id", SEQ)


@query("m4_contiguous_tail", with_sql(LONG, f"""
SELECT {ROW} FROM (
  SELECT *, row_number() OVER (PARTITION BY scenario_file, zone_id ORDER BY event_time, row_seq) AS place,
    count(*) OVER (PARTITION BY scenario_file, zone_id) AS total FROM long)
WHERE place > floor(total * 0.8e0)"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contiguous_tail(long(spark, sf_dir)).select(SCENARIO, "zone_id", SEQ)


@query("j7_not_cached", with_sql(LONG, """
SELECT scenario_file, count(*) AS n FROM long WHERE scenario_file NOT IN ('AHU_annual.csv', 'coi_bias_4_annual.csv') GROUP BY ALL"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, rows = scratch_path(spark, "cache"), long(spark, sf_dir)
    write_cache(rows.filter(F.col(SCENARIO).isin("AHU_annual.csv", "coi_bias_4_annual.csv")), path)
    return not_cached(rows, path).groupBy(SCENARIO).agg(F.count("*").alias("n"))


# --- windows with built-in frames ---------------------------------------------------


def _series(spark: SparkSession, sf_dir: str, columns: dict[str, tuple[str, str, int]], **options: int) -> DataFrame:
    rows = control_errors(long(spark, sf_dir))
    out = add_windows(rows, columns, Order(), **options)
    return rounded(out, *columns).select(SCENARIO, "zone_id", SEQ, *columns)


@query("w1_rolling_mean", with_sql(ERRORS, f"""
SELECT {ROW}, {', '.join(r6(f'avg(valve_tracking_err) {frame(n)}', f'mean_{n}') for n in (15, 60, 120))} FROM errors"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(spark, sf_dir, {f"mean_{n}": ("mean", "valve_tracking_err", n) for n in (15, 60, 120)})


@query("w2_rolling_std", with_sql(ERRORS, f"""
SELECT {ROW}, {', '.join(r6(f'coalesce(stddev_samp(sa_temp_error_c) {frame(n)}, 0)', f'std_{n}') for n in (15, 60, 120))} FROM errors"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(spark, sf_dir, {f"std_{n}": ("std", "sa_temp_error_c", n) for n in (15, 60, 120)})


@query("w3_fan_power", with_sql(ERRORS, f"""
SELECT {ROW}, {r6(f'avg(sf_power_w) {frame(60)}', 'sf_power_w_60_mean')},
  {r6(f'coalesce(stddev_samp(sf_power_w) {frame(60)}, 0)', 'sf_power_w_60_std')} FROM errors"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series are cut into slices here, so the run-up between slices is at work."""
    return _series(spark, sf_dir, {
        "sf_power_w_60_mean": ("mean", "sf_power_w", 60), "sf_power_w_60_std": ("std", "sf_power_w", 60),
    }, max_rows=400)


_LAGS = ["sa_oa_temp_diff_c", "chwc_valve_pct", "oa_damper_pct"]
_BY = "OVER (PARTITION BY scenario_file, zone_id ORDER BY event_time, row_seq)"


@query("w4_lags", with_sql(ERRORS, f"SELECT {ROW}, {', '.join(r6(f'lag({c}) {_BY}', f'{c}_lag1') for c in _LAGS)} FROM errors"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(spark, sf_dir, {f"{c}_lag1": ("lag", c, 1) for c in _LAGS}, max_rows=500)
