"""Column functions: regions, sequences, arrays."""
