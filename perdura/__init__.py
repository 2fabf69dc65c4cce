"""Benchmarking of long-memory estimators on time series, with Spark DataFrames."""

__version__ = "0.1.0"
