"""Trend-following research on long-format price panels, expressed as lazy Spark DataFrames."""
