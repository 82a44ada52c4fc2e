"""Strict sources of raw records."""
