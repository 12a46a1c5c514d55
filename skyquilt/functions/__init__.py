"""Column builders and numeric functions."""
