"""Tidemark: market-series analytics on Spark DataFrames."""
