"""Operators of a training-data pipeline over a ``documents`` relation.

Nothing else in the library imports this subpackage. ``catalog`` registers one
query per operator; the operators themselves take DataFrames and parameters.
"""
