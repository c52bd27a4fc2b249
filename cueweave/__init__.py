"""cueweave: timed-text analytics on Spark DataFrames."""
