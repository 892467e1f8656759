"""Sources of the regime-switching engine."""
