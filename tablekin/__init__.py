"""Column-match analytics over Spark DataFrames."""

__version__ = "0.1.0"
