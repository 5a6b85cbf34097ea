"""Weekly ranking of entities from timestamped event logs, on Spark DataFrames."""

__version__ = "0.1.0"
