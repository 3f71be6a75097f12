"""Spark-native time-series forecasting and decision analytics."""

__version__ = "0.1.0"
