"""The feature cache: Parquet, one partition per scenario file."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airsleuth.errors import DataLoadError, SchemaValidationError
from airsleuth.operators.features import build_features_from_wide
from airsleuth.operators.ordered import MAX_ROWS
from airsleuth.operators.reshape import narrow_floats
from airsleuth.schema import CACHE_COLUMNS, SCENARIO, require_columns
from airsleuth.session import cut_lineage
from airsleuth.sources.csv import list_files, longest_scenario, read_files, scenario_name

COMBINED = "lbnl_features.parquet"
FILE_PREFIX = "lbnl_features_"
ROWS_PER_FILE = 5_000_000


def features_of_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Features of scenario files, which are parsed once.

    The listing tells whether a scenario may be big. If one is, how to cut it is found on the rows as a written table.
    """
    rows = read_files(spark, paths)
    if longest_scenario(spark, paths) <= MAX_ROWS:
        return build_features_from_wide(rows, None)
    return build_features_from_wide(cut_lineage(rows), MAX_ROWS)


def cached_scenarios(spark: SparkSession, path: str) -> list[str]:
    """Scenarios that are in the cache already, from its partition folders alone."""
    return [unquote(p.rstrip("/").rsplit(f"{SCENARIO}=", 1)[1])
            for p in list_files(spark, path, "") if f"{SCENARIO}=" in p]


def not_cached(rows: DataFrame, path: str) -> DataFrame:
    """Rows of scenarios the cache does not hold; of wide rows just as well as of features.

    The names, as many as the cache has folders, are a constant of the plan, so nothing is shuffled.
    """
    names = cached_scenarios(rows.sparkSession, path)
    return rows.filter(F.col(SCENARIO).isNull() | ~F.col(SCENARIO).isin(names)) if names else rows


def build_cache(spark: SparkSession, folder: str, path: str, as_floats: bool = True) -> int:
    """Add the scenario files of a folder that the cache lacks; no other is read. Returns their number."""
    have = set(cached_scenarios(spark, path))
    files = [p for p in list_files(spark, folder) if scenario_name(p) not in have]
    if files:
        write_cache(features_of_files(spark, files), path, as_floats=as_floats)
    return len(files)


def write_cache(features: DataFrame, path: str, force: bool = False, as_floats: bool = True) -> None:
    """Add the scenarios that are not in the cache; with ``force`` replace those that are.

    Tasks write what they hold, so a big scenario gets many files and no
    further shuffle.
    """
    rows = narrow_floats(features) if as_floats else features
    if not force:
        rows = not_cached(rows, path)
    (
        rows.write.mode("overwrite" if force else "append")
        .option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", ROWS_PER_FILE)
        .partitionBy(SCENARIO).parquet(path)
    )


def write_combined(features: DataFrame, path: str, as_floats: bool = True) -> None:
    """All scenarios as one table."""
    rows = narrow_floats(features) if as_floats else features
    rows.write.mode("overwrite").option("maxRecordsPerFile", ROWS_PER_FILE).parquet(path)


def find_cache(spark: SparkSession, folder: str) -> list[str]:
    """Per-scenario cache files of a folder; without any, all Parquet files but the combined one."""
    paths = list_files(spark, folder, ".parquet")
    named = [p for p in paths if p.rsplit("/", 1)[-1].startswith(FILE_PREFIX)]
    return named or [p for p in paths if p.rsplit("/", 1)[-1] != COMBINED]


def column_list(columns: Sequence[str] | None) -> list[str]:
    """Columns once each, in order; the default projection for None."""
    names = list(dict.fromkeys(CACHE_COLUMNS if columns is None else columns))
    if not names:
        raise DataLoadError("at least one column must be read")
    quoted = [c for c in names if '"' in c or not c]
    if quoted:
        raise DataLoadError(f"not a column name: {quoted}")
    return names


def read_cache(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
               scenario: str | None = None) -> DataFrame:
    """Chosen columns of a cache folder; the scan reads no others.

    ``path`` is a cache written here or a folder of per-scenario files.
    """
    names = column_list(columns)
    entries = list_files(spark, path, "")
    if any(f"{SCENARIO}=" in p for p in entries) or any(p.endswith("_SUCCESS") for p in entries):
        table = spark.read.parquet(path)
    else:
        files = find_cache(spark, path)
        if not files:
            raise DataLoadError(f"no cache files in {path}; build the cache first")
        table = spark.read.parquet(*files)
        if SCENARIO not in table.columns:
            table = table.withColumn(SCENARIO, F.col("_metadata.file_name"))
    require_columns(table, names, SchemaValidationError, "build the cache again")
    if scenario is not None:
        table = table.filter(F.col(SCENARIO) == scenario)
    return table.select(*names)
