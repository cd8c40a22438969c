"""Operators over DataFrames and tables."""
