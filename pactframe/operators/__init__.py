"""Operators on whole DataFrames: validation, reports, budgets, output, patches, layers, hooks."""
