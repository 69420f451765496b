"""Operators for preparing training text: mixing, archives, deduplication, filters.

Nothing outside this package imports it.  Each module holds one operator and
the thin query that derives its contract columns; ``registry`` lists them.
"""
