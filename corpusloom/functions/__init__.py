"""Column functions and the constants they use."""
