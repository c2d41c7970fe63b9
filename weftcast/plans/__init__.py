"""Composed plans: the flagship slice, the end-to-end forecast runs and the query catalog."""
