"""Profiling, inference, overrides, conversion and paging over DataFrames."""
