"""Spark-native web-content intelligence: URL, text, scoring, cache, layout, vector and queue operators over DataFrames."""
