"""Web page and text analytics on Spark DataFrames."""
