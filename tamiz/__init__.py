"""tamiz: retrieval, rule and call analytics on Spark DataFrames."""
