"""All registered queries and their SQL twins."""

import importlib

from airsleuth.catalog.base import ORACLES, QUERIES

for _part in ("ingest", "events", "learned", "contracts", "streams", "guards"):
    importlib.import_module(f"{__name__}.{_part}")

__all__ = ["ORACLES", "QUERIES"]
