"""Column expressions: business days, costs, strings, statistics."""
