"""Tesserql: dialect-faithful SQL analytics on Spark DataFrames."""
