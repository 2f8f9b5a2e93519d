"""Column functions and small DataFrame idioms that the operators share."""
