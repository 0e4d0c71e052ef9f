"""millrace: batch map / group / reduce analytics on Spark DataFrames."""
