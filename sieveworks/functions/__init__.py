"""Column functions the operators share."""
