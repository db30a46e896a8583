"""Dataset curation, audit and evaluation operators declared on Spark DataFrames."""
