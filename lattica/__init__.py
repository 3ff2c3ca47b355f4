"""Lattica: layered-graph analytics over Spark DataFrames."""
