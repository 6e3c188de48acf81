"""Column expressions and node transforms."""
