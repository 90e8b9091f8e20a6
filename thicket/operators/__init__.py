"""Operators of the forest engine."""
