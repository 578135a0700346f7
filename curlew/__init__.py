"""Recommendation data engine on Spark DataFrames."""
