"""Operators for preparing large training corpora.

Every module offers a general operator on DataFrames; `queries` binds them to
the given tables.  Nothing outside this subpackage imports it.
"""
