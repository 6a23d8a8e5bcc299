"""Dependency leakage and selective deletion on Spark DataFrames."""
