"""Bound statements, their lowering to DataFrames, and access paths."""
