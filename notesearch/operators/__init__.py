"""Relational operators: everything is a DataFrame of rows, batched over many queries at once."""
