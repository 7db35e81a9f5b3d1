"""Column functions and vectorised functions."""
