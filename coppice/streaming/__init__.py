"""Fitted trees on streaming tables."""
