"""Literature knowledge-graph analytics on Spark DataFrames."""
