"""Column expressions of the rule language."""
