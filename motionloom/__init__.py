"""Motionloom: Spark-native analytics over body-landmark time series."""

__version__ = "0.1.0"
