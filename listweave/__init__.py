"""Collecting and maintaining listing data with Spark DataFrames."""
