"""Runs registered queries beside their SQL in DuckDB and compares whole results.

``python tests/oracle.py [sf_dir] [name part ...]`` prints one line per query.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "pages", "benchmark", "labels"]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.sql("SET TimeZone = 'UTC'")
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def normal_form(frame: pd.DataFrame) -> pd.DataFrame:
    """Columns and rows sorted, values as text."""
    frame = frame[sorted(frame.columns)]
    text = frame.map(lambda v: "null" if v is None or v is pd.NaT or v != v else
                     repr(float(v)) if isinstance(v, float) else str(v))
    for name in frame.columns:
        if pd.api.types.is_numeric_dtype(frame[name]) and not pd.api.types.is_bool_dtype(frame[name]):
            text[name] = [("null" if pd.isna(v) else repr(float(v))) for v in frame[name]]
    return text.sort_values(list(text.columns)).reset_index(drop=True)


def difference(got: pd.DataFrame, expected: pd.DataFrame) -> str | None:
    """What differs, or None."""
    if sorted(got.columns) != sorted(expected.columns):
        return f"columns {sorted(got.columns)} != {sorted(expected.columns)}"
    if len(got) != len(expected):
        return f"{len(got)} rows != {len(expected)}"
    a, b = normal_form(got), normal_form(expected)
    if a.equals(b):
        return None
    both = a.merge(b, how="outer", indicator=True)
    odd = both[both["_merge"] != "both"]
    return f"{len(odd)} rows differ, e.g.\n{odd.head(6).to_string()}"


def types_of(df: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in df.schema}


def main() -> None:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from airsleuth.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark: SparkSession = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if parts and not any(name.startswith(p) for p in parts):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            got = df.toPandas()
            took = time.time() - start
            if name not in oracles:
                print(f"rows  {name}: {len(got)} rows, {took:.1f} s", flush=True)
                continue
            relation = connection.sql(oracles[name])
            verdict = difference(got, relation.df())
            kinds = dict(zip(relation.columns, map(str, relation.types)))
        except Exception as error:  # noqa: BLE001 - one failing query must not hide the others
            verdict, took, got, kinds = f"{type(error).__name__}: {str(error)[:1500]}", time.time() - start, [], {}
        bad += verdict is not None
        sql_time = time.time() - start - took
        print(f"{'ok   ' if verdict is None else 'BAD  '} {name}: {len(got)} rows, {took:.1f} s, sql {sql_time:.1f} s"
              + (f"\n      {verdict}\n      {kinds}" if verdict else ""), flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
