"""Models of the regime-switching engine."""
