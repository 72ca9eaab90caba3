"""Position-overlay analytics over daily bars, on Spark DataFrames."""

__version__ = "0.1.0"
