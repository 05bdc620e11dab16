"""Reading inputs, naming their columns, and writing results."""
