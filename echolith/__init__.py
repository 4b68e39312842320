"""Acoustic signatures and corpus preparation on Spark DataFrames."""
