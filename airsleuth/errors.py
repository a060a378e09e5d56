"""Typed errors; each names what is missing or wrong."""

from __future__ import annotations


class AirsleuthError(Exception):
    """Base class of every error the library raises."""


class DataLoadError(AirsleuthError):
    """No matching input, or an input that cannot be labelled."""


class SchemaValidationError(DataLoadError):
    """Required columns are missing."""


class FeatureEngineeringError(AirsleuthError):
    """Features or metrics cannot be computed from this input."""


class DetectorNotFittedError(AirsleuthError):
    """A detector was used before it was fitted."""


class StoreError(AirsleuthError):
    """A read or write of the event or job store failed."""


class ReportError(AirsleuthError):
    """A report was asked for in an unknown format."""
