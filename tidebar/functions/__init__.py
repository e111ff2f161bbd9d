"""Column functions: prices, costs, statistics."""
