"""Queries of the guards: what they name on derived tables, and the rows they let through."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airsleuth.catalog.base import FEATURE_ROWS, HITS, LONG, WIDE, features, long, query, wide, with_sql
from airsleuth.detectors.base import RuleDetector
from airsleuth.detectors.classifier import FaultClassifier
from airsleuth.detectors.scores import IsolationForestDetector, MixtureDetector, ReconstructionDetector
from airsleuth.errors import DataLoadError, DetectorNotFittedError, SchemaValidationError
from airsleuth.schema import FEATURES, HIT_COLUMNS, RAW_COLUMNS, SCENARIO, require_columns
from airsleuth.session import scratch_path
from airsleuth.sources.cache import FILE_PREFIX, column_list, find_cache, read_cache, write_cache, write_combined


def said(check: Callable[[], object], error: type[Exception]) -> str:
    """What a guard says against its input; empty if nothing."""
    try:
        check()
    except error as found:
        return str(found)
    return ""


def per_scenario(rows: DataFrame, message: str) -> DataFrame:
    return rows.groupBy(SCENARIO).agg(F.count("*").alias("n"), F.lit(message).alias("said"))


@query("s6_schema_check", with_sql(WIDE, """
SELECT scenario_file, count(*) AS n, 'missing columns: [''MA_TEMP'', ''SF_WAT'']' AS said FROM wide GROUP BY ALL"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows that lack two columns."""
    rows = wide(spark, sf_dir).drop("SF_WAT", "MA_TEMP")
    return per_scenario(rows, said(lambda: require_columns(rows, RAW_COLUMNS), SchemaValidationError))


@query("p8_column_guards", with_sql(FEATURE_ROWS, """
SELECT scenario_file, count(*) AS n, 'missing columns: [''sf_power_w'']; build the cache again' AS said FROM features GROUP BY ALL"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows that lack a signal; whole ones pass."""
    rows = features(spark, sf_dir)
    assert said(lambda: require_columns(rows, FEATURES), SchemaValidationError) == ""
    short = rows.drop("sf_power_w")
    return per_scenario(short, said(
        lambda: require_columns(short, ["sf_power_w", *FEATURES], hint="build the cache again"), SchemaValidationError))


@query("s11_cache_discovery", with_sql(LONG, "SELECT fault_type, count(*) AS n FROM long GROUP BY ALL"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by label and a combined one in a folder; only the former are found."""
    folder, rows = scratch_path(spark, "cache"), long(spark, sf_dir)
    faults = [r[0] for r in rows.select("fault_type").distinct().collect()]  # the labels
    for fault in faults:
        rows.filter(F.col("fault_type") == fault).write.parquet(f"{folder}/{FILE_PREFIX}{fault}.parquet")
    write_combined(rows, f"{folder}/lbnl_features.parquet", as_floats=False)
    return spark.read.parquet(*find_cache(spark, folder)).groupBy("fault_type").agg(F.count("*").alias("n"))


@query("s12_drift_check", with_sql(LONG, """
SELECT scenario_file, count(*) AS n, 'missing columns: [''sf_power_w_60_mean'']; build the cache again' AS said FROM long GROUP BY ALL"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache from before a feature was added."""
    path = scratch_path(spark, "cache")
    write_cache(long(spark, sf_dir), path)
    message = said(lambda: read_cache(spark, path, [SCENARIO, "sf_power_w_60_mean"]), SchemaValidationError)
    return per_scenario(read_cache(spark, path, [SCENARIO]), message)


@query("s13_projection", with_sql(LONG, """
SELECT scenario_file, count(sf_power_w) AS power, count(zone_id) AS zones,
  'at least one column must be read' AS none, 'not a column name: [''a"b'']' AS quoted FROM long GROUP BY ALL"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated names are read once; an empty list and a quoted name are refused."""
    names = column_list([SCENARIO, "sf_power_w", "zone_id", "sf_power_w"])
    return long(spark, sf_dir).select(*names).groupBy(SCENARIO).agg(
        F.count("sf_power_w").alias("power"), F.count("zone_id").alias("zones"),
        F.lit(said(lambda: column_list([]), DataLoadError)).alias("none"),
        F.lit(said(lambda: column_list(['a"b']), DataLoadError)).alias("quoted"))


_UNFITTED = {"IsolationForestDetector": IsolationForestDetector, "MixtureDetector": MixtureDetector,
             "ReconstructionDetector": ReconstructionDetector, "FaultClassifier": FaultClassifier}


@query("d15_not_fitted", with_sql(LONG, f"""
SELECT scenario_file, d AS detector, count(*) AS n, d || ' must be fitted first' AS said
FROM long, (SELECT unnest({list(_UNFITTED)}) AS d) GROUP BY ALL"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every learned detector refuses rows before it has learned."""
    rows = long(spark, sf_dir)
    told = {n: said(lambda make=make: make().predict(rows), DetectorNotFittedError) for n, make in _UNFITTED.items()}
    messages = F.explode(F.create_map(*[F.lit(x) for pair in told.items() for x in pair])).alias("detector", "said")
    return rows.groupBy(SCENARIO).agg(F.count("*").alias("n")).select(SCENARIO, "n", messages)


@query("d16_detector_contract", with_sql(HITS, """
SELECT r.scenario_file, count(*) AS n, count(r.ground_truth) AS labelled, count(r.anomaly_index) AS indexed, true AS whole
FROM rule_events r GROUP BY ALL"""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitting and predicting in one gives hits in the contract's columns."""
    hits = RuleDetector().fit_predict(features(spark, sf_dir))
    whole = hits.columns[:1 + len(HIT_COLUMNS)] == [SCENARIO, *HIT_COLUMNS]
    return hits.groupBy(SCENARIO).agg(
        F.count("*").alias("n"), F.count("ground_truth").alias("labelled"), F.count("anomaly_index").alias("indexed"),
        F.lit(whole).alias("whole"))
