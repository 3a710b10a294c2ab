"""Column and table functions."""
