"""Transaction-behaviour analytics on Spark DataFrames."""
