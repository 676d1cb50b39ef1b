"""Waymark: landmark analytics on Spark DataFrames."""
