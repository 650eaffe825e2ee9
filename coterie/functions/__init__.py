"""Column helpers and small DataFrame helpers shared by the operators."""
