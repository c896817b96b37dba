"""Operators for building training data from large document collections.

Each module holds one operator with a general interface; ``queries.py`` applies them to
the given tables. Nothing outside this package imports it.
"""
