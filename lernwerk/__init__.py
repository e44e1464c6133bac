"""Study and assessment analytics on Spark DataFrames."""
