"""Column expressions (scalar operators)."""
