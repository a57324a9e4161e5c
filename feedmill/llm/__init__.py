"""Operators for large text-corpus preparation: one module per operator, queries in ``queries.py``."""
