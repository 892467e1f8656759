"""Plans of the regime-switching engine."""
