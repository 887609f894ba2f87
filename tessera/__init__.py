"""Content-intelligence analytics on Spark DataFrames."""
