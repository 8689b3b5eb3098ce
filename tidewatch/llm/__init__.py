"""Operators of a training-data pipeline.

Nothing outside this package imports it. Each operator module has a DataFrame
function with its own interface; ``queries`` derives the registered digests.
"""
