"""Sources of the forest engine."""
