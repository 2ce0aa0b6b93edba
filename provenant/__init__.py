"""Spark-native analytics for auditing citations of search-augmented answers."""

__version__ = "0.1.0"
