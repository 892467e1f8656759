"""Operators of the regime-switching engine."""
