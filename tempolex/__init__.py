"""Temporal text analytics on Spark: versioned legal text as DataFrames."""

__version__ = "0.1.0"
