"""Operators that prepare text corpora for language-model training.

Nothing outside this subpackage imports it.  Each module holds one operator; ``queries.py`` holds
the thin registered queries that apply them to the shared test tables.
"""
