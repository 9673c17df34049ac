"""Operators on collections as DataFrames of (k, doc)."""
