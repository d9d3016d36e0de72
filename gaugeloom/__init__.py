"""Recorded-telemetry analytics as Spark DataFrame operators."""
