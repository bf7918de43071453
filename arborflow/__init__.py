"""Gradient-boosted trees over distributed and federated tables, on Spark DataFrames."""
