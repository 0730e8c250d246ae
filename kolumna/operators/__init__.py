"""Relational operators: bound plans to DataFrames."""

from kolumna.operators.relational import aggregated, filtered, projected, run_select

__all__ = ["aggregated", "filtered", "projected", "run_select"]
