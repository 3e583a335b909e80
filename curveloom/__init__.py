"""Curve-ordered point analytics on Spark DataFrames."""
