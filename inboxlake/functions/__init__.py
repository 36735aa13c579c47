"""Column expressions: language votes, text, time and JSON helpers."""
