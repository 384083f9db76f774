"""Shopping-list matching and basket comparison on Spark DataFrames."""
