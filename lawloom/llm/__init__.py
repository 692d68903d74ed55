"""Operators for training-data pipelines over ``documents``-like tables."""
