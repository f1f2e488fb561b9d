"""larkspur: product-discovery analytics on Spark DataFrames and Structured Streaming."""
