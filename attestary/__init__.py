"""Evidence jobs on Spark DataFrames."""
