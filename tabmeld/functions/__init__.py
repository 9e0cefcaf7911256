"""Column expressions over header names and cell text."""
