"""Relational and key/value analytics on Spark DataFrames."""
