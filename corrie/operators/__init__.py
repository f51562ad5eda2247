"""Relational operators over scoped DataFrames."""
