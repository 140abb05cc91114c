"""trajspark: ordered-event trajectory analytics on Spark DataFrames."""
