"""Column functions: strict text and JSON scalars, and small vectorized helpers."""
