"""Streaming of the regime-switching engine."""
