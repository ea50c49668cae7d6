"""Training-data operators: each takes DataFrames, runs as Spark jobs and returns a DataFrame."""
