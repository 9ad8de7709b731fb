"""Operators of a training-data pipeline: one module each, DataFrame in, DataFrame out.

Nothing outside this subpackage imports it.
"""
