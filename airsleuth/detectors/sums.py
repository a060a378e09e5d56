"""Sums of arrays over all rows: each task adds up its own, Spark adds up the tasks'."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airsleuth.detectors.runs import COUNT
from airsleuth.schema import FEATURES


def summed(df: DataFrame, of_batch: Callable[[pd.DataFrame, np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all batches of what ``of_batch`` makes of a batch's FEATURES and of how many rows each stands for;
    zeros without rows. Rows of a table without counts stand for themselves.

    A task sends one row for each entry that is not 0, so the result's size alone bounds what is shuffled by a task and
    collected.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(int(np.prod(shape)))
        for rows in batches:
            if len(rows):
                total += of_batch(rows[FEATURES], rows[COUNT].to_numpy(float)).ravel()
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at, "s": total[at]})

    counts = F.col(COUNT) if COUNT in df.columns else F.lit(1).alias(COUNT)
    found = df.select(*FEATURES, counts).mapInPandas(run, "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).toPandas()
    out = np.zeros(int(np.prod(shape)))
    out[found["at"]] = found["s"]
    return out.reshape(shape)
