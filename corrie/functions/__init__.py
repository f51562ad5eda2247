"""Column functions with the dialect's semantics."""
