"""Streaming of the forest engine."""
