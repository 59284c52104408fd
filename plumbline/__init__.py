"""Tabular analytics and data preparation on Spark DataFrames."""
