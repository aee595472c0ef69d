"""Operators over DataFrames: aggregates, windows, paging, relations, writes."""
