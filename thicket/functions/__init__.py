"""Functions of the forest engine."""
