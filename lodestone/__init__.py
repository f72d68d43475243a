"""Lodestone: analytics over recognition results and dataset curation, on Spark DataFrames."""
