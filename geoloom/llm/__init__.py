"""Operators for large training-data jobs.

Nothing outside this subpackage imports it.  Every operator takes a
``documents``-like (or ``embeddings``-like) DataFrame, picks the columns it
needs by name, and returns a new DataFrame; other columns are left alone or
ignored, so clashing names in the input do no harm.
"""
