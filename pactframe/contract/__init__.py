"""Declarations of contracts and their compilation to columns."""
