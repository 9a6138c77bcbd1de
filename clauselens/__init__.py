"""clauselens."""
