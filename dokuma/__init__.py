"""Spark-native text pre-processing and corpus analytics for Turkish text."""

__version__ = "0.1.0"
