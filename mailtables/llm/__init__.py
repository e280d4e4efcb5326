"""Operators for large training-data pipelines, their queries and their checking SQL."""
