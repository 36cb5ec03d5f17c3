"""Network-based multi-label inference on Spark DataFrames."""
