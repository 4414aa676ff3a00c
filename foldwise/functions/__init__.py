"""Column expressions: built-in functions only, no Python in the hot path."""
