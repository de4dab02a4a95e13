"""Spark-native analytics over code knowledge graphs."""

__version__ = "0.1.0"
