"""Queries of rules, fusion, evaluation, bursts, sequences and reads of stored events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airsleuth.catalog.base import (
    DETECTIONS, HITS, LONG, RULES, detections, features, long, micros, query, r6, rounded, wide,
    with_sql,
)
from airsleuth.catalog.ingest import JOBS, jobs
from airsleuth.operators.evaluation import (
    alert_bursts, class_report, class_summary, confusion_counts, confusion_matrix, detection_report,
    fault_recall, first_events, gaps, label_detections, scenario_report, time_to_detect,
)
from airsleuth.operators.features import wide_features
from airsleuth.operators.fusion import (
    agreed_by_several, annotate, attach_truth, event_keys, first_labels, flagged_rows, fuse, stack,
)
from airsleuth.operators.ordered import with_position
from airsleuth.operators.reshape import copy_to_zones
from airsleuth.operators.rules import READ, rule_events, rule_hits
from airsleuth.operators.sequence import pad_head, sequence_windows
from airsleuth.operators.splits import first_years
from airsleuth.operators.serving import (
    DetectionFilter, count_detections, daily_view, detection_page, detection_statistics, event_view, page_after, token_of,
    filter_detections, job_by_id, recent_jobs, run_view,
)
from airsleuth.schema import FAULT_TYPES, NORMAL, ROW_KEYS, SCENARIO, SEQ, TIME, ZONE_COLUMNS

HIT = ["violated_policy", "alert_level", "anomaly_index", "trigger_signal", "detector_source", "ground_truth"]
HIT_SQL = ("scenario_file, epoch_us(event_time) AS event_us, zone_id, violated_policy, alert_level, "
           "round(anomaly_index, 6) AS anomaly_index, trigger_signal, detector_source, ground_truth")


def shown(events: DataFrame, *extra: str) -> DataFrame:
    """Events in a form that compares well: times as microseconds, index rounded."""
    return events.select(
        SCENARIO, micros("event_time").alias("event_us"), "zone_id",
        *[F.round(c, 6).alias(c) if c == "anomaly_index" else F.col(c) for c in [*HIT, *extra]],
    )


# --- rules ------------------------------------------------------------------------


def _register_rule(no: int, policy: str) -> None:
    @query(f"r{no}_{policy.lower()}", with_sql(HITS, f"SELECT {HIT_SQL} FROM hits WHERE rule_no = {no}"))
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shown(rule_hits(features(spark, sf_dir)).filter(F.col("rule_no") == no))


for _no, _rule in enumerate(RULES, start=1):
    _register_rule(_no, _rule["policy"])


@query("r6_rule_events", with_sql(HITS, f"SELECT {HIT_SQL} FROM rule_events"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(rule_events(features(spark, sf_dir)))


@query("r6_hits_per_rule", with_sql(HITS, """
SELECT violated_policy, alert_level, count(*) AS hits, round(max(anomaly_index), 6) AS strongest FROM hits GROUP BY ALL"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_hits(features(spark, sf_dir)).groupBy("violated_policy", "alert_level").agg(
        F.count("*").alias("hits"), F.round(F.max("anomaly_index"), 6).alias("strongest"))


@query("w7_first_rule_wins", with_sql(HITS, "SELECT violated_policy, scenario_file, count(*) AS n FROM rule_events GROUP BY ALL"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_events(features(spark, sf_dir)).groupBy("violated_policy", SCENARIO).agg(F.count("*").alias("n"))


# --- fusion -----------------------------------------------------------------------
# A simple second detector for the fusion queries: outside air far from the mixed air.


def _delta_hits(rows: DataFrame) -> DataFrame:
    delta = F.col("ma_oa_delta_c")
    return rows.filter(delta > 3).select(
        SCENARIO, "event_time", "zone_id", F.lit("ANOMALY_SCORE").alias("violated_policy"),
        F.when(delta > 5, "CRITICAL").otherwise("WARNING").alias("alert_level"), (delta / 2).alias("anomaly_index"),
        F.lit("ma_oa_delta_c").alias("trigger_signal"), F.lit("delta").alias("detector_source"),
        F.lit(None).cast("string").alias("ground_truth"),
    )


def _both(rows: DataFrame) -> DataFrame:
    return stack([rule_events(rows), _delta_hits(rows)])


BOTH = HITS + """,
delta_hits AS (
  SELECT scenario_file, event_time, zone_id, 'ANOMALY_SCORE' AS violated_policy,
    CASE WHEN ma_oa_delta_c > 5 THEN 'CRITICAL' ELSE 'WARNING' END AS alert_level, ma_oa_delta_c / 2 AS anomaly_index,
    'ma_oa_delta_c' AS trigger_signal, 'delta' AS detector_source, NULL::VARCHAR AS ground_truth
  FROM features WHERE ma_oa_delta_c > 3),
both_hits AS (
  SELECT scenario_file, event_time, zone_id, violated_policy, alert_level, anomaly_index, trigger_signal, detector_source, ground_truth
  FROM rule_events UNION ALL SELECT * FROM delta_hits),
fused AS (
  SELECT b.*, all_sources FROM (
    SELECT * FROM both_hits QUALIFY row_number() OVER (PARTITION BY scenario_file, event_time, zone_id
      ORDER BY anomaly_index DESC, detector_source = 'rules' DESC, detector_source, violated_policy, trigger_signal) = 1) b
  JOIN (SELECT scenario_file, event_time, zone_id, string_agg(DISTINCT detector_source, '|' ORDER BY detector_source) AS all_sources
        FROM both_hits GROUP BY ALL) s USING (scenario_file, event_time, zone_id))"""


@query("o5_union_of_hits", with_sql(BOTH, f"SELECT {HIT_SQL} FROM both_hits"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(_both(features(spark, sf_dir)))


@query("w8_strongest_hit", with_sql(BOTH, f"SELECT {HIT_SQL} FROM fused"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(fuse(_both(features(spark, sf_dir))))


@query("a1_all_sources", with_sql(BOTH, "SELECT all_sources, violated_policy, count(*) AS n FROM fused GROUP BY ALL"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse(_both(features(spark, sf_dir))).groupBy("all_sources", "violated_policy").agg(F.count("*").alias("n"))


@query("a1_multi_source_events", with_sql(BOTH, """
SELECT count(*) AS events, count(*) FILTER (contains(all_sources, '|')) AS multi_source FROM fused"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreed_by_several(fuse(_both(features(spark, sf_dir))))


@query("j4_winner_with_sources", with_sql(BOTH, f"SELECT {HIT_SQL}, all_sources FROM fused WHERE contains(all_sources, '|')"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(fuse(_both(features(spark, sf_dir))).filter(F.col("all_sources").contains("|")), "all_sources")


@query("o6_distinct_keys", with_sql(BOTH, "SELECT DISTINCT scenario_file, epoch_us(event_time) AS event_us, zone_id FROM both_hits"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_keys(_both(features(spark, sf_dir))).select(SCENARIO, micros("event_time").alias("event_us"), "zone_id")


@query("j1_flagged_rows", with_sql(HITS, """
SELECT scenario_file, zone_id, row_seq FROM features
WHERE (scenario_file, event_time, zone_id) IN (SELECT (scenario_file, event_time, zone_id) FROM rule_events)"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir)
    return flagged_rows(rows, rule_events(rows)).select(SCENARIO, "zone_id", SEQ)


def _verdicts(rows: DataFrame) -> DataFrame:
    """A stand-in classifier that reads all rows and says nothing of normal ones."""
    return rows.filter(F.col("fault_type") != NORMAL).select(
        *ROW_KEYS, F.col("fault_type").alias("predicted_fault"), (F.col(SEQ) % 64 / F.lit(64.0)).alias("confidence"))


@query("j2_annotated_events", with_sql(HITS, """
SELECT r.scenario_file, epoch_us(r.event_time) AS event_us, r.zone_id, violated_policy, c.fault_type AS predicted_fault,
  (c.row_seq % 64) / 64e0 AS confidence
FROM rule_events r LEFT JOIN (SELECT * FROM long WHERE fault_type <> 'normal') c
  ON r.scenario_file = c.scenario_file AND r.event_time = c.event_time AND r.zone_id = c.zone_id"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir)
    events = annotate(rule_events(rows), _verdicts(long(spark, sf_dir)))
    return events.select(SCENARIO, micros("event_time").alias("event_us"), "zone_id", "violated_policy", "predicted_fault", "confidence")


@query("j3_attached_truth", with_sql(BOTH, """
SELECT f.scenario_file, epoch_us(f.event_time) AS event_us, f.zone_id, violated_policy, l.fault_type AS ground_truth
FROM fused f LEFT JOIN (SELECT DISTINCT scenario_file, event_time, zone_id, fault_type FROM long) l
  USING (scenario_file, event_time, zone_id)"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir)
    return attach_truth(fuse(_both(rows)), long(spark, sf_dir)).select(
        SCENARIO, micros("event_time").alias("event_us"), "zone_id", "violated_policy", "ground_truth")


@query("w9_first_label", with_sql(LONG, """
SELECT scenario_file, hour_us, zone_id, fault_type AS ground_truth, row_seq % 2 = 0 AS even_first FROM (
  SELECT *, epoch_us(date_trunc('day', event_time)) AS hour_us FROM long)
QUALIFY row_number() OVER (PARTITION BY scenario_file, hour_us, zone_id ORDER BY row_seq) = 1"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row keys repeat here because times are cut to days."""
    rows = long(spark, sf_dir).withColumn("event_time", F.date_trunc("day", "event_time"))
    tagged = rows.withColumn("fault_type", F.concat_ws("/", "fault_type", (F.col(SEQ) % 2 == 0).cast("string")))
    parts = F.split("ground_truth", "/")
    return first_labels(tagged).select(
        SCENARIO, micros("event_time").alias("hour_us"), "zone_id",
        parts[0].alias("ground_truth"), parts[1].cast("boolean").alias("even_first"))


@query("w10_first_event", with_sql(HITS, """
SELECT scenario_file, epoch_us(date_trunc('day', event_time)) AS day_us, zone_id, violated_policy, row_seq FROM hits
QUALIFY row_number() OVER (PARTITION BY scenario_file, day_us, zone_id ORDER BY rule_no, row_seq) = 1"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = rule_hits(features(spark, sf_dir)).withColumn("event_time", F.date_trunc("day", "event_time"))
    return first_events(hits, ["rule_no", SEQ]).select(
        SCENARIO, micros("event_time").alias("day_us"), "zone_id", "violated_policy", SEQ)


# --- evaluation -------------------------------------------------------------------


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with detections; the rules are the detector and name the fault by policy."""
    rows = features(spark, sf_dir)
    policy = F.create_map(*[F.lit(v) for v in (
        "VALVE_STUCK", "coi_stuck", "DAMPER_STUCK", "damper_stuck", "COIL_LEAKAGE", "coi_leakage", "SA_SETPOINT_BIAS", "coi_bias",
    )])
    events = rule_events(rows).withColumn("predicted_fault", policy[F.col("violated_policy")])
    unlabelled = F.when(F.col("row_seq") % 29 != 0, F.col("fault_type"))
    return label_detections(long(spark, sf_dir).withColumn("fault_type", unlabelled), events)


LABELLED = HITS + """,
labelled_rows AS (
  SELECT l.scenario_file, l.event_time, l.zone_id, CASE WHEN l.row_seq % 29 <> 0 THEN l.fault_type END AS fault_type,
    r.violated_policy IS NOT NULL AS detected,
    coalesce(CASE r.violated_policy WHEN 'VALVE_STUCK' THEN 'coi_stuck' WHEN 'DAMPER_STUCK' THEN 'damper_stuck'
      WHEN 'COIL_LEAKAGE' THEN 'coi_leakage' WHEN 'SA_SETPOINT_BIAS' THEN 'coi_bias' END, 'normal') AS predicted_fault
  FROM long l LEFT JOIN rule_events r USING (scenario_file, event_time, zone_id))"""


@query("j5_labelled_detections", with_sql(LABELLED, """
SELECT scenario_file, epoch_us(event_time) AS event_us, zone_id, fault_type, detected, predicted_fault FROM labelled_rows"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).select(
        SCENARIO, micros("event_time").alias("event_us"), "zone_id", "fault_type", "detected", "predicted_fault")


@query("p19_labelled_counts", with_sql(LABELLED, """
SELECT scenario_file, count(fault_type) AS labelled, count(*) - count(fault_type) AS skipped FROM labelled_rows GROUP BY ALL"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).groupBy(SCENARIO).agg(
        F.count("fault_type").alias("labelled"), F.count_if(F.col("fault_type").isNull()).alias("skipped"))


@query("a7_detection_report", with_sql(LABELLED, """
SELECT n_evaluated, n_skipped, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 4) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 4) AS recall,
  round(CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 4) AS f1
FROM (SELECT count(fault_type) AS n_evaluated, count(*) - count(fault_type) AS n_skipped,
  count(*) FILTER (fault_type <> 'normal' AND detected) AS tp, count(*) FILTER (fault_type = 'normal' AND detected) AS fp,
  count(*) FILTER (fault_type <> 'normal' AND NOT detected) AS fn FROM labelled_rows)"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection_report(_labelled(spark, sf_dir))


@query("a8_fault_recall", with_sql(LABELLED, """
SELECT fault_type, count(*) AS support, round(count(*) FILTER (detected) / count(*), 4) AS recall
FROM labelled_rows WHERE fault_type <> 'normal' GROUP BY ALL"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fault_recall(_labelled(spark, sf_dir))


REPORT = LABELLED + """,
valid AS (SELECT fault_type AS truth, predicted_fault AS prediction FROM labelled_rows WHERE fault_type IS NOT NULL),
per_class AS (
  SELECT label, count(*) FILTER (truth = label AND prediction = label) AS tp,
    count(*) FILTER (truth = label) AS true_n, count(*) FILTER (prediction = label) AS pred_n
  FROM valid, (SELECT truth AS label FROM valid UNION SELECT prediction FROM valid) GROUP BY label)"""


@query("a9_class_report", with_sql(REPORT, """
SELECT label, round(CASE WHEN pred_n > 0 THEN tp / pred_n ELSE 0 END, 4) AS precision,
  round(CASE WHEN true_n > 0 THEN tp / true_n ELSE 0 END, 4) AS recall, round(2 * tp / (true_n + pred_n), 4) AS f1, true_n AS support
FROM per_class"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_report(confusion_counts(_labelled(spark, sf_dir), "fault_type", "predicted_fault"))


@query("a10_confusion_matrix", with_sql(REPORT, f"""
SELECT truth, {', '.join(f"count(*) FILTER (prediction = '{f}') AS {f}" for f in FAULT_TYPES)} FROM valid GROUP BY truth"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusion_matrix(confusion_counts(_labelled(spark, sf_dir), "fault_type", "predicted_fault"), FAULT_TYPES)


@query("a11_class_summary", with_sql(REPORT, """
SELECT n_evaluated, n_skipped, accuracy, macro_f1 FROM
  (SELECT count(*) AS n_evaluated, round(avg((truth = prediction)::INT), 4) AS accuracy FROM valid),
  (SELECT count(*) AS n_skipped FROM labelled_rows WHERE fault_type IS NULL),
  (SELECT round(avg(2 * tp / (true_n + pred_n)), 4) AS macro_f1 FROM per_class)"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_summary(confusion_counts(_labelled(spark, sf_dir), "fault_type", "predicted_fault"))


STARTS = {"coi_bias": datetime(2024, 2, 1), "coi_stuck": datetime(2024, 7, 1, 12), "oa_bias": datetime(2024, 12, 31)}


def _delays() -> str:
    cases = " ".join(f"WHEN '{f}' THEN TIMESTAMP '{t}'" for f, t in STARTS.items())
    return with_sql(DETECTIONS, f"""
SELECT ground_truth, round(avg((epoch_us(event_time) - epoch_us(started)) / 6e7), 4) AS mean_delay_min
FROM (SELECT *, CASE ground_truth {cases} END AS started FROM detections) WHERE started IS NOT NULL GROUP BY ALL""")


@query("a12_time_to_detect", _delays())
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return time_to_detect(detections(spark, sf_dir), STARTS)


@query("j6_fault_starts", with_sql(DETECTIONS, f"""
SELECT id, round((epoch_us(event_time) - epoch_us(started)) / 6e7, 4) AS delay_min
FROM detections JOIN (VALUES {', '.join(f"('{f}', TIMESTAMP '{t}')" for f, t in STARTS.items())}) s(fault, started) ON ground_truth = fault"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of one event each is that event's own delay."""
    return time_to_detect(
        detections(spark, sf_dir).filter(F.col("ground_truth").isin(list(STARTS))), STARTS, by=["id"],
    ).select("id", F.col("mean_delay_min").alias("delay_min"))


@query("a13_scenario_report", with_sql(LABELLED, """
SELECT scenario_file, count(*) AS n, count(*) FILTER (detected) AS detected_rows,
  CASE WHEN bool_and(coalesce(fault_type, '') <> 'normal') THEN 'fault_recall'
       WHEN bool_and(coalesce(fault_type, '') = 'normal') THEN 'normal_fpr' ELSE 'mixed' END AS kind,
  CASE WHEN bool_and(coalesce(fault_type, '') <> 'normal') OR bool_and(coalesce(fault_type, '') = 'normal')
       THEN round(count(*) FILTER (detected) / count(*), 4) END AS rate
FROM labelled_rows GROUP BY scenario_file"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenario_report(_labelled(spark, sf_dir))


# --- bursts -----------------------------------------------------------------------


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = [SCENARIO, TIME, SEQ, "fault_type", *READ, *ZONE_COLUMNS]
    rows = copy_to_zones(wide_features(wide(spark, sf_dir), keep=read))
    return rule_hits(rows).groupBy(*ROW_KEYS).agg(F.min(SEQ).alias(SEQ))


GAPS = HITS + """,
gaps AS (
  SELECT scenario_file, zone_id, event_time, row_seq,
    epoch_us(event_time) - epoch_us(lag(event_time) OVER (PARTITION BY scenario_file, zone_id ORDER BY event_time, row_seq)) AS gap_us
  FROM rule_events)"""


@query("w5_gaps", with_sql(GAPS, f"SELECT scenario_file, zone_id, row_seq, {r6('gap_us / 6e7', 'gap_min')} FROM gaps"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(gaps(_alerts(spark, sf_dir)), "gap_min").select(SCENARIO, "zone_id", SEQ, "gap_min")


def _bursts_sql(minutes: int) -> str:
    return with_sql(GAPS + f""",
numbered AS (
  SELECT *, sum(CASE WHEN gap_us IS NULL OR gap_us > {minutes * 60_000_000} THEN 1 ELSE 0 END)
    OVER (PARTITION BY scenario_file, zone_id ORDER BY event_time, row_seq) AS burst FROM gaps)""", """
SELECT scenario_file, zone_id, epoch_us(min(event_time)) AS start_us, epoch_us(max(event_time)) AS end_us, count(*) AS rows
FROM numbered GROUP BY scenario_file, zone_id, burst""")


def _bursts(df: DataFrame) -> DataFrame:
    return df.select(SCENARIO, "zone_id", micros("burst_start").alias("start_us"), micros("burst_end").alias("end_us"), "rows")


@query("w6_alert_bursts", _bursts_sql(600))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap limit of ten hours, as the derived rows lie hours apart; series are cut into slices."""
    return _bursts(alert_bursts(_alerts(spark, sf_dir), 600, max_rows=200))


@query("w6_bursts_five_minutes", _bursts_sql(5))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bursts(alert_bursts(_alerts(spark, sf_dir)))


# --- sequences --------------------------------------------------------------------


@query("w11_sequence_windows", with_sql(LONG, """
SELECT scenario_file, zone_id, row_seq, fault_type, list_sum(speeds) AS speed_sum, speeds[1] AS oldest, speeds[30] AS newest FROM (
  SELECT *, list(sf_speed_pct::FLOAT::DOUBLE) OVER (PARTITION BY scenario_file, zone_id ORDER BY event_time, row_seq
    ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS speeds FROM long) WHERE len(speeds) = 30"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = sequence_windows(long(spark, sf_dir), ["sf_speed_pct", "rf_speed_pct"], max_rows=300)
    speeds = F.transform("window", lambda row: row[0].cast("double"))
    return windows.select(SCENARIO, "zone_id", SEQ, "fault_type", speeds.alias("s")).select(
        SCENARIO, "zone_id", SEQ, "fault_type", F.aggregate("s", F.lit(0.0), lambda a, b: a + b).alias("speed_sum"),
        F.element_at("s", 1).alias("oldest"), F.element_at("s", -1).alias("newest"))


@query("w12_padded_head", with_sql(LONG, """
SELECT scenario_file, zone_id, row_seq, coalesce(p, first_value(p IGNORE NULLS) OVER (PARTITION BY scenario_file, zone_id
  ORDER BY event_time, row_seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS p
FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY scenario_file, zone_id ORDER BY event_time, row_seq) >= 30 THEN sf_speed_pct END AS p FROM long)"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The speed of rows that end a whole window stands for a prediction."""
    rows = long(spark, sf_dir)
    ended = sequence_windows(rows, ["sf_speed_pct"]).select(SCENARIO, "zone_id", SEQ, F.col("sf_speed_pct").alias("p"))
    joined = rows.join(ended, [SCENARIO, "zone_id", SEQ], "left")
    return pad_head(joined, "p").select(SCENARIO, "zone_id", SEQ, "p")


# --- reads of stored events -------------------------------------------------------

WINDOW = DetectionFilter(start=datetime(2024, 3, 1), end=datetime(2024, 6, 30, 12), zone_id="zone_2", alert_level="WARNING")
WINDOW_SQL = "event_time >= TIMESTAMP '2024-03-01' AND event_time <= TIMESTAMP '2024-06-30 12:00:00' AND zone_id = 'zone_2' AND alert_level = 'WARNING'"
_EVENT = "id, epoch_us(event_time) AS event_us, zone_id, equipment_id, alert_level, predicted_fault, anomaly_index"


def _events(df: DataFrame) -> DataFrame:
    return df.select("id", micros("event_time").alias("event_us"), "zone_id", "equipment_id", "alert_level", "predicted_fault", "anomaly_index")


@query("p18_filtered_events", with_sql(DETECTIONS, f"SELECT {_EVENT} FROM detections WHERE {WINDOW_SQL}"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(filter_detections(detections(spark, sf_dir), WINDOW))


@query("p18_filter_by_fault", with_sql(DETECTIONS, f"SELECT {_EVENT} FROM detections WHERE predicted_fault = 'coi_stuck'"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(filter_detections(detections(spark, sf_dir), DetectionFilter(fault_type="coi_stuck")))


@query("a2_count", with_sql(DETECTIONS, f"SELECT count(*) AS total FROM detections WHERE {WINDOW_SQL}"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_detections(detections(spark, sf_dir), WINDOW)


@query("a3_statistics", with_sql(DETECTIONS, """
SELECT 'total' AS dimension, NULL AS value, count(*) AS detections FROM detections
UNION ALL SELECT 'alert_level', alert_level, count(*) FROM detections GROUP BY alert_level
UNION ALL SELECT 'fault_type', coalesce(nullif(predicted_fault, ''), 'unknown') AS f, count(*) FROM detections GROUP BY f
UNION ALL SELECT 'equipment', equipment_id, count(*) FROM detections GROUP BY equipment_id"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection_statistics(detections(spark, sf_dir))


@query("o2_page", with_sql(DETECTIONS, f"SELECT {_EVENT} FROM detections ORDER BY event_time DESC, id DESC LIMIT 500 OFFSET 250"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(detection_page(detections(spark, sf_dir), skip=250))


@query("o2_token_pages", with_sql(DETECTIONS, f"SELECT {_EVENT} FROM detections ORDER BY event_time DESC, id DESC LIMIT 1500"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pages, each found by where the one before ended."""
    events, token, pages = detections(spark, sf_dir), None, []
    for _ in range(3):
        pages.append(page_after(events, token))
        token = token_of(pages[-1]) or token
    return _events(pages[0].unionByName(pages[1]).unionByName(pages[2]))


@query("o2_deep_page", """
SELECT l_orderkey, l_linenumber, l_shipdate_us FROM (SELECT l_orderkey, l_linenumber, epoch_us(l_shipdate) AS l_shipdate_us,
  l_orderkey * 8 + l_linenumber AS id FROM lineitem) ORDER BY l_shipdate_us DESC, id DESC LIMIT 1000 OFFSET (SELECT count(*) // 2 + 25000 FROM lineitem)""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page from the middle of the line items by ship date."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", F.col("l_shipdate").cast("timestamp").alias("event_time"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"))
    page = detection_page(items, page_size=1000, skip=items.count() // 2 + 25000, seek_beyond=10_000)
    return page.select("l_orderkey", "l_linenumber", micros("event_time").alias("l_shipdate_us"))


@query("o1_series_order", with_sql(LONG, """
SELECT scenario_file, zone_id, row_seq, row_number() OVER (PARTITION BY scenario_file, zone_id ORDER BY event_time, row_seq) AS position,
  count(*) OVER (PARTITION BY scenario_file, zone_id) AS series_rows FROM long"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_position(long(spark, sf_dir), max_rows=300).select(SCENARIO, "zone_id", SEQ, "position", "series_rows")


@query("o3_recent_jobs", with_sql(JOBS, "SELECT id, scenario, status, started_us FROM jobs ORDER BY started_us DESC, id DESC LIMIT 20"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recent_jobs(jobs(spark, sf_dir)).select("id", "scenario", "status", micros("started_at").alias("started_us"))


@query("o4_job_by_id", with_sql(JOBS, "SELECT id, scenario, status, started_us, finished_us FROM jobs WHERE id = 7"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_by_id(jobs(spark, sf_dir), 7).select(
        "id", "scenario", "status", micros("started_at").alias("started_us"), micros("finished_at").alias("finished_us"))


VIEW = DETECTIONS + """,
event_view AS (
  SELECT id AS detection_id, * EXCLUDE (id, ground_truth, predicted_fault), coalesce(ground_truth, 'unknown') AS ground_truth,
    coalesce(predicted_fault, 'unknown') AS predicted_fault FROM detections)"""
_DAILY = f"""
SELECT strftime(event_time, '%Y-%m-%d') AS event_date, equipment_id, zone_id, alert_level, predicted_fault, detector_source,
  count(*) AS detection_count, {r6('avg(anomaly_index)', 'mean_anomaly_index')}, {r6('avg(confidence)', 'mean_confidence')}
FROM event_view GROUP BY ALL"""


@query("v1_event_view", with_sql(VIEW, """
SELECT * EXCLUDE (event_time, created_at), epoch_us(event_time) AS event_us, epoch_us(created_at) AS created_us FROM event_view"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = event_view(detections(spark, sf_dir))
    return view.withColumns({"event_us": micros("event_time"), "created_us": micros("created_at")}).drop("event_time", "created_at")


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = daily_view(event_view(detections(spark, sf_dir)))
    return rounded(cube, "mean_anomaly_index", "mean_confidence").withColumn("event_date", F.col("event_date").cast("string"))


@query("v2_daily_view", with_sql(VIEW, _DAILY))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily(spark, sf_dir)


@query("a4_daily_rule_events", with_sql(HITS, f"""
SELECT strftime(event_time, '%Y-%m-%d') AS event_date, zone_id, alert_level, count(*) AS detection_count,
  {r6('avg(anomaly_index)', 'mean_anomaly_index')} FROM rule_events GROUP BY ALL"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = rule_events(features(spark, sf_dir)).groupBy(
        F.to_date("event_time").cast("string").alias("event_date"), "zone_id", "alert_level"
    ).agg(F.count("*").alias("detection_count"), F.avg("anomaly_index").alias("mean_anomaly_index"))
    return rounded(cube, "mean_anomaly_index")


@query("v3_run_view", with_sql(JOBS, """
SELECT id AS pipeline_job_id, scenario, status, (finished_us - started_us) / 1e6 AS duration_sec, records_processed, anomalies_found, error_msg
FROM jobs"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_view(jobs(spark, sf_dir)).drop("started_at", "finished_at")


@query("a15_first_years", with_sql(LONG, "SELECT scenario_file, min(year(event_time))::INT AS base_year FROM long GROUP BY ALL"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_years(long(spark, sf_dir))
