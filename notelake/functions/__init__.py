"""Column functions: text, paths and property blocks."""
