"""Forecast verification on Spark DataFrames."""
