"""Spark-native message screening, guard analytics and training-data operators."""

__version__ = "0.1.0"
