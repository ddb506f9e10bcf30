"""Spark-native tabularization of long event histories, and data-preparation operators beside it."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
