"""Document, graph and search queries on Spark DataFrames."""
