"""Labelled-vector analytics on Spark DataFrames."""
