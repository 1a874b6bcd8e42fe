"""Table understanding and preparation on Spark DataFrames."""
