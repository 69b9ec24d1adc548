"""spandrel: analytics over source code and its documentation on Spark DataFrames."""
