"""Security analytics over text and code corpora on Spark DataFrames."""
