"""Sensor diagnostics and corpus preparation on Spark DataFrames."""
