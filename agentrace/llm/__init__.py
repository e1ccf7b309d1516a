"""Operators of a training-data pipeline and their registered queries.

Nothing else in the library imports this subpackage. Every operator takes a DataFrame, picks the
columns it is told to use by name, and ignores all others.
"""
