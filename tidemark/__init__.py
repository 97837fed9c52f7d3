"""Tidemark: causal change-point analytics on Spark DataFrames."""
