"""Literature analytics on Spark DataFrames."""
