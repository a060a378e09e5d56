"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def tune(spark: SparkSession) -> SparkSession:
    """The setting the operators count on: times are in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def local_session(cpus: int | str = 8, memory: str = "8g", name: str = "airsleuth") -> SparkSession:
    """A session for tests and the local bench; a cluster brings its own."""
    return tune(
        SparkSession.builder.master(f"local[{cpus}]").appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may do without the setting: all its threads share a
    temporary folder, which is set once per context.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="airsleuth-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path no other run uses, below a folder of this application in the shared folder.

    ``free_scratch`` deletes the application's folder once its results have been consumed.
    """
    application = spark.sparkContext.applicationId
    return f"{shared_folder(spark).rstrip('/')}/airsleuth-{application}/{name}-{uuid.uuid4().hex}"


def free_scratch(spark: SparkSession) -> None:
    """Delete all that this application wrote to its folder in the shared one. For callers that have
    consumed their results; nothing that still reads such tables may run afterwards."""
    place = spark._jvm.org.apache.hadoop.fs.Path(
        f"{shared_folder(spark).rstrip('/')}/airsleuth-{spark.sparkContext.applicationId}")
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` as a written table, so that a lost executor costs no recomputation of its past."""
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
