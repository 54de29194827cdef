"""Spark-native analytics for marketplace listing data."""

__version__ = "0.1.0"
