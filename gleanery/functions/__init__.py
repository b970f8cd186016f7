"""Column expressions for texts and paths."""
