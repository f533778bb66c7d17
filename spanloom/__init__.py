"""Region by signal matrices, and the preparation of training text, on Spark DataFrames."""
