"""Spark-native analytics over accelerator launch telemetry."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
