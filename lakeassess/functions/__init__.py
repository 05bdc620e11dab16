"""Column functions and grouped helpers shared by the operators."""
