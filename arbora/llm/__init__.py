"""Operators for large-scale training-data pipelines.

Nothing outside this folder imports it; the rest of the library works without it.
"""
