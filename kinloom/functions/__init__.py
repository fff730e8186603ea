"""Column functions on sequences and proportions."""
