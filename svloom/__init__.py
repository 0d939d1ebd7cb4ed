"""Structural-variant analytics and data-processing operators on Spark DataFrames."""
