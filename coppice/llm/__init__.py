"""Operators of a training-data pipeline over text: thirteen operators and their queries."""
