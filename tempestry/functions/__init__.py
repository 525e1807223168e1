"""Column expressions used by several operators."""
