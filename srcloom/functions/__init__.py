"""Column-level functions: text scalars, C source extraction, reply validation."""
