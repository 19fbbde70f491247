"""Curation and query operators for geographic point data, on Spark DataFrames."""
