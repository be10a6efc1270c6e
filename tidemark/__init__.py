"""tidemark: record linkage, review, search and evaluation over captured text, on Spark DataFrames."""
