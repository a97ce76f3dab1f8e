"""Time-series indicators on Spark DataFrames."""
