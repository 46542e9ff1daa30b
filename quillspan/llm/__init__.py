"""Operators for preparing large text corpora.

Nothing outside this subpackage imports it.  Each module holds one operator
with its own interface and the thin query that applies it to whole tables.
"""
