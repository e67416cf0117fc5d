"""Vector-similarity search and evaluation on Spark DataFrames."""
