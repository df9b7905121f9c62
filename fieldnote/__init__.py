"""Practice-operations and text-evaluation analytics on Spark DataFrames."""
