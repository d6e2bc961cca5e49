"""Time-series clustering and comparison on Spark DataFrames."""
