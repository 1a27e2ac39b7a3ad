"""casebook: case-retrieval analytics on Spark DataFrames."""
