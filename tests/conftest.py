from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from airsleuth.session import free_scratch, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "6g", "airsleuth-tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    free_scratch(session)
    session.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def features(spark):
    """Features of the smallest tables, computed once."""
    from airsleuth.catalog.base import features as build
    from airsleuth.session import cut_lineage

    return cut_lineage(build(spark, SF))
