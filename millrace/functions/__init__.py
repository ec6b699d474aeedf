"""Column helpers for the scalar functions of other SQL dialects."""
