"""wordweave: word-association graph analytics on Spark DataFrames."""
