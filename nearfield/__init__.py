"""Vector search, metadata filters and durable collections on Spark DataFrames."""
