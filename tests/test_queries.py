"""Every registered query with SQL equals it on the smallest tables; streams in more detail."""

from __future__ import annotations

import sys
from datetime import datetime, timedelta

import pytest

import __spark_entry__ as entry
from airsleuth.catalog import ORACLES, QUERIES
from airsleuth.operators.ordered import Order
from airsleuth.operators.rules import rule_events
from airsleuth.streaming.streams import RuleStream, burst_sessions, drain
from tests.conftest import SF
from tests.oracle import connect, difference



@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert difference(QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()) is None


def test_entry(spark):
    events = entry.entry(spark)
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert events.count() > 0 and set(oracles) <= set(queries) and set(QUERIES) <= set(queries) and set(ORACLES) <= set(oracles)


def test_queries_without_a_library_that_training_data_needs(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("airsleuth.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "zstandard", None)
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLES)


def test_repeated_batch_gives_the_same_events(spark, features, tmp_path):
    from airsleuth.schema import COLUMN_MAP

    rows = features.select("scenario_file", "fault_type", "row_seq", "zone_id", *COLUMN_MAP.values())
    half = datetime(2024, 7, 1)
    stream = RuleStream(spark, str(tmp_path), Order())
    for batch, part in enumerate((rows.filter(rows.event_time < half), rows.filter(rows.event_time >= half))):
        stream.process(part, batch)
        stream.process(part, batch)
    assert stream.events().count() == rule_events(features).count()


def test_open_burst_is_held_back(spark, tmp_path):
    base = datetime(2024, 1, 1)
    rows = [("s", "z", base + timedelta(minutes=m)) for m in (0, 4, 20, 24, 2000)]
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows, "scenario_file string, zone_id string, event_time timestamp").write.parquet(folder)
    source = spark.readStream.schema("scenario_file string, zone_id string, event_time timestamp").parquet(folder)
    got = drain(burst_sessions(source, late="10 minutes"), spark, str(tmp_path / "run")).collect()
    assert sorted(r["rows"] for r in got) == [2, 2]
