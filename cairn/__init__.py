"""Memory-corpus jobs on Spark: every job takes DataFrames and returns a DataFrame."""
