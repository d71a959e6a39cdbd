"""brindle: retrieval and text analytics on Spark DataFrames."""
