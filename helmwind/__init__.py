"""Regime-switching analytics on Spark DataFrames."""
