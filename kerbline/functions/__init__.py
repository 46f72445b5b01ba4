"""Column expressions: no operator here adds a shuffle."""
