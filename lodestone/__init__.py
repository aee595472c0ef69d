"""Lodestone: an analytics engine over Spark DataFrames."""
