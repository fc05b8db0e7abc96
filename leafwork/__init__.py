"""leafwork: document analytics on Spark DataFrames."""
