"""Paperloom: document analytics on Spark DataFrames."""
