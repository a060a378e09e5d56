"""Fault detection on building telemetry as Spark DataFrame operators."""
