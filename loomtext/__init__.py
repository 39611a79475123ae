"""Spark-native document analytics: every step is a function from DataFrame to DataFrame."""

__version__ = "0.1.0"
