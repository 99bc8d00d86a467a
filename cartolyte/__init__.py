"""Layered-archive map data as Spark DataFrames."""
