"""gridloom: key-range, spatial and request-stream analytics as Spark DataFrames."""
