"""Operators of a training-data pipeline over ``documents`` tables.

Every module is one operator with its own general interface; ``queries.py``
holds the thin ``opN_*`` queries and their SQL.  Nothing outside this
subpackage imports it.
"""
