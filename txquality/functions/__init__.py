"""Column expressions: features, labels, hashing and rounding."""
