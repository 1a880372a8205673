"""Search-ranking analytics on Spark DataFrames."""
