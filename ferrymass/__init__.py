"""Optimal transport over Spark DataFrames: measures, costs and points in; couplings and diagnostics out."""

__version__ = "0.1.0"
