"""Functions of the regime-switching engine."""
