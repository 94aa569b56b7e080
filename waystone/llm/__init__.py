"""Operators for large-scale training-data pipelines, each a DataFrame -> DataFrame function."""
