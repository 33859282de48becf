"""Spark-native point-in-time analytics for daily panel data."""

__version__ = "0.1.0"
