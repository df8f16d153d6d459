"""Comparison of ordered 3-D point chains on Spark DataFrames."""

__version__ = "0.1.0"
