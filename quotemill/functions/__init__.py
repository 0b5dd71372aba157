"""Column functions: text, time and identity expressions."""
