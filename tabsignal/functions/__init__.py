"""Column expressions: scalar functions and rule metrics."""
