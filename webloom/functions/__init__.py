"""Column expressions and the small per-row helpers used by the operators."""
