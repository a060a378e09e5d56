"""The pipeline's stages on the smallest tables, and queries beside their SQL."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from airsleuth.llm.queries import ORACLES, QUERIES
from airsleuth.llm.tables import freeing
from tests.conftest import SF
from tests.oracle import difference


@pytest.fixture(autouse=True)
def clean():
    with freeing():
        yield


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels"):
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    assert difference(QUERIES[name](spark, SF).toPandas(), connection.sql(ORACLES[name]).df()) is None


def test_stages(spark, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == columns
            sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[1] < sizes[0] and sizes[3] < sizes[2]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    left = spark.read.parquet(str(tmp_path / "quality")).join(labels, "doc_id").groupBy("quality").count().collect()
    assert {r.quality for r in left} == {1}
    leaks = QUERIES["op1_decontamination"](spark, SF).select("doc_id")
    assert spark.read.parquet(str(tmp_path / "decontamination")).join(leaks, "doc_id").count() == 0
    whole = corpus_pipeline.run(spark, SF)
    assert whole.agg(F.sum("length")).first() == docs.agg(F.sum("length")).first()
