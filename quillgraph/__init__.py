"""Spark-native analytics over document collections."""

__version__ = "0.1.0"
