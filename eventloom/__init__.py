"""Event pattern matching and event-stream analytics on Spark DataFrames."""
