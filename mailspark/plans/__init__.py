"""Chained jobs over the state tables."""
