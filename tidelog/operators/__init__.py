"""Relational operators of the query language."""
