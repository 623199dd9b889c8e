"""Operators of a training-data pipeline over documents, vectors and pages.

Nothing else in the package imports this subpackage; ``registry`` lists its
queries and their SQL.
"""
