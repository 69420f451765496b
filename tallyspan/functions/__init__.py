"""Column functions that the measures share."""
