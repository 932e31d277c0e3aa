"""Column helpers and ordered (prefix) computations."""
