"""Temporal graph analytics on Spark DataFrames."""
