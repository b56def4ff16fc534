"""tidemark: representative-period analytics on Spark DataFrames."""
