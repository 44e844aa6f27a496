"""Fit-once, replay-everywhere analytics on Spark DataFrames."""
