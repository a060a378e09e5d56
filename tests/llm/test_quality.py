"""Co-training on held-out labels, and the rules of its exchange."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from airsleuth.llm.quality import CALIBRATE, _in_proportion, co_train, features, score_quality
from airsleuth.llm.tables import freeing

SF01 = "/root/testdata/sf0.01"


@pytest.fixture(autouse=True)
def clean():
    with freeing():
        yield


def test_held_out_labels(spark):
    """Learned from half of the labels, judged on the other: the exchange does no harm."""
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2))
    right = {}
    for rounds in (0, 3):
        model = co_train(docs, labels.filter(half == 0), rounds=rounds)
        right[rounds] = score_quality(docs, model).join(labels.filter(half == 1), "doc_id").agg(
            F.avg((F.col("good") == (F.col("quality") == 1)).cast("int"))).first()[0]
    assert right[3] >= right[0] and right[3] >= 0.98


def test_handed_rows_keep_the_labels_proportion():
    rows = lambda n: (np.zeros((n, 2)), np.zeros((n, 3)), np.zeros(n), np.zeros(n))
    for bad, good, share, expected in ((1000, 1000, 0.9, (111, 1000)), (10, 1000, 0.5, (10, 10)), (0, 50, 0.9, (0, 0)), (300, 90, 0.25, (270, 90))):
        assert tuple(len(r[2]) for r in _in_proportion([rows(bad), rows(good)], share)) == pytest.approx(expected, abs=1)


def test_copies_stand_on_one_side(spark, prose):
    """Equal texts under other ids, and rows that repeat an id, never both teach and calibrate."""
    docs = spark.createDataFrame([(i, prose(i % 10, 20)) for i in range(40)] + [(0, prose(0, 20))] * 5, "doc_id long, text string")
    found = features(docs).toPandas()
    assert found.groupby("content")["doc_id"].nunique().tolist() == [4] * 10
    assert found.assign(hold=found["content"] % CALIBRATE == 0).groupby("content")["hold"].nunique().max() == 1
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    once, twice = co_train(docs, labels), co_train(docs.unionByName(docs), labels)
    assert np.allclose(once.content.weights, twice.content.weights)
