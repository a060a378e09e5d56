"""Scenario files: wide CSV files whose names tell their label."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote, unquote_plus

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airsleuth.errors import DataLoadError, SchemaValidationError
from airsleuth.functions.columns import fault_of_file, parse_time, to_double
from airsleuth.schema import FILE_KEYS, RAW_COLUMNS, RAW_TIME, SCENARIO, SEQ


def infer_fault_type(name: str) -> str:
    """Label told by a file name; fails for a name that tells none."""
    for key, fault in FILE_KEYS.items():
        if key in name.lower():
            return fault
    raise DataLoadError(f"cannot infer a fault type from file name {name!r}")


def key_for_fault(fault: str) -> str:
    """File name part of a label."""
    for key, value in FILE_KEYS.items():
        if value == fault:
            return key
    raise DataLoadError(f"no file name part is registered for fault type {fault!r}")


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def list_files(spark: SparkSession, folder: str, suffix: str = ".csv") -> list[str]:
    """Sorted paths in ``folder`` with the suffix; only the listing, no content."""
    hadoop, fs = _file_system(spark, folder)
    if not fs.exists(hadoop):
        return []
    return sorted(p for p in (s.getPath().toString() for s in fs.listStatus(hadoop)) if p.endswith(suffix))


HEADERS_AT_ONCE = 32
#: A part of a scenario has places below 2 ** 44: its bytes times 32, up to 500 GB.
_PART_BITS = 44
_PARTITION = f"{SCENARIO}="
#: Numbers of part files up to which they are broadcast, some hundred bytes each; more are joined by a shuffle.
BROADCAST_PARTS = 200_000


def _name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1].removeprefix(_PARTITION)


def _stem(path: str) -> str:
    return _name(path).rsplit(".", 1)[0].lower()


def scenario_name(path: str) -> str:
    """File name of a scenario, as its rows carry it."""
    return unquote(_name(path))


def _parts(spark: SparkSession, path: str) -> list[str]:
    """Files of a scenario: itself, or the parts in its folder, sorted."""
    hadoop, fs = _file_system(spark, path)
    if not fs.getFileStatus(hadoop).isDirectory():
        return [path]
    return [p for p in list_files(spark, path) if not p.rsplit("/", 1)[-1].startswith(("_", "."))]


def _line(spark: SparkSession, file: str, number: int) -> str:
    """A line near the start of a file; empty if the file has fewer."""
    hadoop, fs = _file_system(spark, file)
    io = spark.sparkContext._jvm.java.io
    reader = io.BufferedReader(io.InputStreamReader(fs.open(hadoop), "UTF-8"))
    try:
        for _ in range(number):
            reader.readLine()
        return reader.readLine() or ""
    finally:
        reader.close()


def _header(spark: SparkSession, file: str) -> tuple[str, ...]:
    """Column names of a file; reads one line only."""
    return tuple(next(csv.reader([_line(spark, file, 0).removeprefix("\ufeff")]), ()))


def _headers(spark: SparkSession, files: Sequence[str]) -> dict[str, tuple[str, ...]]:
    """Column names of each file, many files at a time. A task per file would read a block for a line."""
    with ThreadPoolExecutor(HEADERS_AT_ONCE) as pool:
        return dict(zip(files, pool.map(lambda f: _header(spark, f), files)))


def _path_key(path: str) -> str:
    """A path in the form of ``_file_key``."""
    scheme, _, place = unquote_plus(path).partition(":")
    return f"{scheme}:{place.lstrip('/')}"


def _file_key() -> Column:
    """The file of a row; slashes after the scheme differ between listings and rows."""
    path = F.url_decode("_metadata.file_path")
    place = F.ltrim(F.substr(path, F.instr(path, ":") + 1), F.lit("/"))
    return F.concat(F.substring_index(path, ":", 1), F.lit(":"), place)


def _entry() -> Column:
    """The entry of the folder that a row's file belongs to: the file itself, or the folder of its parts."""
    path = F.url_decode("_metadata.file_path")
    folder = F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    entry = F.when(F.endswith(folder, F.lit(".csv")), folder).otherwise(F.substring_index(path, "/", -1))
    return F.when(F.startswith(entry, F.lit(_PARTITION)), F.substr(entry, F.lit(len(_PARTITION) + 1))).otherwise(entry)


def longest_scenario(spark: SparkSession, paths: Sequence[str]) -> int:
    """Rows of the longest scenario, estimated by its bytes and the first line of its data.

    It decides how series are cut for parallel work, never what a query returns.
    """
    longest = 0
    for path in paths:
        hadoop, fs = _file_system(spark, path)
        line = next(filter(None, (_line(spark, p, 1) for p in _parts(spark, path))), "")
        longest = max(longest, fs.getContentSummary(hadoop).getLength() // (len(line) + 1))
    return longest


def read_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Typed rows of scenarios, with file name, label and place in the file.

    A scenario is a CSV file, or a folder of parts when one file would be too
    big. Columns are bound by name: the header of every part is read, parts with the
    same header are read together, and those whose columns differ in order or number are
    united. Places go on from one part of a scenario to the next.
    """
    parts = {f: (number, path) for path in paths for number, f in enumerate(_parts(spark, path))}
    headers = _headers(spark, list(parts)) if parts else {}
    groups: dict[tuple[str, ...], list[str]] = {}
    for file, (_, path) in parts.items():
        lacking = sorted(set(RAW_COLUMNS) - set(headers[file]))
        if lacking:
            raise SchemaValidationError(f"{_name(path)}: missing columns: {lacking}")
        infer_fault_type(_stem(path))
        groups.setdefault(headers[file], []).append(file)
    for path in set(paths) - {path for _, path in parts.values()}:
        raise SchemaValidationError(f"{_name(path)}: no parts")
    # Only scenarios of several parts need their numbers.
    later = [(_path_key(f), number) for f, (number, _) in parts.items() if number]
    united = None
    for names, members in groups.items():
        text = T.StructType([T.StructField(c, T.StringType()) for c in names])
        part = spark.read.schema(text).option("header", True).csv(members)
        part = part.select(
            *[F.col(f"`{c}`") for c in names],
            _entry().alias("_file"),
            *([_file_key().alias("_part")] if later else []),
            # blocks of a file by their start, then rows of a task in reading order
            (F.col("_metadata.file_block_start") * F.lit(32)
             + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).alias("_place"),
        )
        united = part if united is None else united.unionByName(part, allowMissingColumns=True)
    if later:
        numbers = spark.createDataFrame(later, "_later string, _number long")
        numbers = F.broadcast(numbers) if len(later) <= BROADCAST_PARTS else numbers
        before = F.call_function("shiftleft", F.coalesce("_number", F.lit(0).cast("long")), F.lit(_PART_BITS))
        united = united.join(numbers, F.col("_part") == F.col("_later"), "left").withColumn(
            "_place", before + F.col("_place")).drop("_part", "_later", "_number")
    own = {SCENARIO, SEQ, "fault_type"}
    extra = [c for c in united.columns if c not in {*RAW_COLUMNS, *own, "_file", "_place"}]
    return united.select(
        F.col("_file").alias(SCENARIO),
        fault_of_file(F.regexp_replace("_file", r"\.[^.]*$", "")).alias("fault_type"),
        (F.col(SEQ).cast("long") if SEQ in united.columns else F.col("_place")).alias(SEQ),
        parse_time(F.col(RAW_TIME)).alias(RAW_TIME),
        *[to_double(c).alias(c) for c in RAW_COLUMNS if c != RAW_TIME],
        *[F.col(f"`{c}`") for c in extra],
    )


def find_files(spark: SparkSession, folder: str, scenario: str | None = None) -> list[str]:
    """Files whose name contains ``scenario`` in any case; None and 'all' mean all files."""
    paths = list_files(spark, folder)
    if scenario and scenario != "all":
        paths = [p for p in paths if scenario.lower() in _stem(p)]
    if not paths:
        wanted = f" for scenario {scenario!r}" if scenario else ""
        raise DataLoadError(f"no CSV files in {folder}{wanted}")
    return paths


def scan_files(spark: SparkSession, folder: str, scenario: str | None = None) -> DataFrame:
    """Rows of the files whose name contains ``scenario`` in any case; None and 'all' mean all files."""
    return read_files(spark, find_files(spark, folder, scenario))


def load_all(spark: SparkSession, folder: str) -> DataFrame:
    return scan_files(spark, folder)


def load_scenario(spark: SparkSession, folder: str, fault_type: str) -> DataFrame:
    """All files of one label; other files are not opened."""
    return scan_files(spark, folder, key_for_fault(fault_type))


def write_files(wide: DataFrame, folder: str) -> None:
    """Raw wide rows as scenario CSV files, each a folder of parts."""
    rows = wide.withColumn(RAW_TIME, F.date_format(RAW_TIME, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    rows.write.option("header", True).partitionBy(SCENARIO).csv(folder)
