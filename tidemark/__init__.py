"""Corpus quality and evaluation trust on Spark DataFrames."""

__version__ = "0.1.0"
