"""Column and join helpers shared by the operators."""
