"""Reading the tables, clashing columns, and tables kept for a while in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airsleuth.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


_SCOPES: list[list] = []


@contextmanager
def freeing() -> Iterator[None]:
    """Frees at its end what was kept inside; for callers that have written the result by then."""
    scope: list[Kept] = []
    _SCOPES.append(scope)
    try:
        yield
    finally:
        _SCOPES.remove(scope)
        for kept in scope:
            kept.free()


class Kept:
    """A DataFrame written to the shared folder, so that lost executors cost no recomputation of its past.

    ``free`` deletes the files once nothing that reads them is left to run; what
    a returned result still reads stays until the application's folder is deleted.
    """

    def __init__(self, df: DataFrame, name: str, codec: str = "snappy", parts: int | None = None) -> None:
        self.spark = df.sparkSession
        for scope in _SCOPES:
            scope.append(self)
        self.path = scratch_path(self.spark, name)
        (df if parts is None else df.coalesce(parts)).write.option("compression", codec).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def free(self) -> None:
        delete(self.spark, self.path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
