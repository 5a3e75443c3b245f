"""Reading the input tables and writing the results."""
