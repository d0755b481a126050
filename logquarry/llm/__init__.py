"""Operators for training-data pipelines over a ``documents`` table, and their queries.

Nothing else in the library imports this package. Each module is one operator; ``queries``
registers the thin ``opN_`` queries over the given tables.
"""
